"""The identifier catalogue: rules, labels and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from redactum.functions.sql import BLANKS, BOUNDARY, to_java


@dataclass(frozen=True)
class Rule:
    """``gate``: lower-case texts of which a text must hold one to match; ``digit``: it needs one.

    ``first``: a class of what a match starts with, tried before all else at a place; it and
    ``fast``, a Java pattern with the same matches, only save time. ``anywhere``: a match may
    start with a letter beyond ASCII.
    """

    label: str
    category: str
    description: str
    pattern: str
    flags: str
    priority: int
    groups: int = 0
    gate: tuple[str, ...] = ()
    digit: bool = False
    first: str = ""
    fast: str = ""
    anywhere: bool = False

    @property
    def java(self) -> str:
        if self.fast:
            return self.fast
        java = to_java(self.pattern, self.flags)
        head = java[: java.index(")") + 1] if self.flags.startswith("i") else ""
        ahead = f"(?={self.first})" if self.first else ""
        # Letters fold beyond ASCII under both flags only, so the class has to stand behind them there.
        return head + ahead + java[len(head) :] if "u" in self.flags else ahead + java


# The patterns, in their own dialect, with labels, categories and priorities.
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_NAME_WORD = r"(?:(?:al|el|bin|binti|van|von|der|den|de|del|della|di|da|ter|ten|la|le)[-' ]){0,2}(?:\p{Lu}\.|\p{Lu}[\p{L}\-']{1,30})"
_BOX = r"[A-Za-z0-9._%+\-]"
# An address starts where its run of characters does, or where the match before has ended: no run is tried from every place in it.
_EMAIL = rf"(?:\G|(?<!{_BOX})){_BOX}++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}"
# What may not stand before five digits is looked for only where five digits are.
_ZIP = rf"(?=[0-9]{{5}})(?<!\w)(?<!(?:ISO|IEC|RFC|DIN|ANSI|IEEE|NIST|EN|BS|SP)[{BLANKS}/\-])\d{{5}}(?:-\d{{4}})?{BOUNDARY}"
RULES: tuple[Rule, ...] = (
    Rule("EMAIL", "HIPAA", "Email address", r"[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}", "i", 95, 0, ("@",), fast=_EMAIL),
    Rule("URL", "HIPAA", "Web URL", r'\bhttps?:\/\/[^\s<>"]+|\bwww\.[A-Z0-9.\-]+\.[A-Z]{2,}(?:\/[^\s<>"]*)?', "i", 92, 0, ("http", "www."), first="[HWhw]"),
    Rule("IP", "HIPAA", "IP address", rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b", "", 90, 0, (".",), True, first="[0-9]"),
    Rule("IP", "HIPAA", "IPv6 address", r"\b(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4}\b", "i", 90, 0, (":",), first="[A-Fa-f0-9]"),
    Rule("SSN", "HIPAA", "US Social Security Number", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", "", 100, 0, ("-",), True, first="[0-9]"),
    Rule("NHS_NUMBER", "EU", "UK NHS Number", r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{4}\b", "", 88, 0, (), True, first="[0-9]"),
    Rule("UK_NINO", "EU", "UK National Insurance Number", r"\b(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", "i", 100, 0, (), True, first="[A-CEGHJ-PR-TW-Za-ceghj-pr-tw-z]"),
    Rule("NATIONAL_ID_DK_CPR", "EU", "Denmark CPR", r"\b\d{6}-\d{4}\b", "", 98, 0, ("-",), True, first="[0-9]"),
    Rule("NATIONAL_ID_ES", "EU", "Spain DNI/NIE", r"\b(?:[XYZ]\d{7}|\d{8})[\-\s]?[A-Z]\b", "", 95, 0, (), True, first="[0-9XYZ]"),
    Rule("NATIONAL_ID_IT_CF", "EU", "Italy Codice Fiscale", r"\b[A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z]\b", "", 98, 0, (), True, first="[A-Z]"),
    Rule("NATIONAL_ID_CH_AHV", "EU", "Switzerland AHV", r"\b756[\.\s]?\d{4}[\.\s]?\d{4}[\.\s]?\d{2}\b", "", 98, 0, ("756",), first="7"),
    Rule("NATIONAL_ID_NL_BSN", "EU", "Netherlands BSN", r"\b(?:BSN|burgerservicenummer)\s*[:.\-]?\s*(\d{8,9})\b", "i", 95, 1, ("bsn", "burger"), True, first="[Bb]"),
    Rule("IBAN", "EU", "IBAN bank account", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "", 95, 0, (), True, first="[A-Z]"),
    Rule("PASSPORT", "EU", "Passport number", r"\bpassport\s+(?:no|number|#)\s*[:.\-]?\s*([A-Z0-9]{6,12})\b", "i", 95, 1, ("passport",), first="[Pp]"),
    Rule("PHONE", "HIPAA", "Phone number", r"(?<!\d)(?:\+\d{1,3}[\s\-\.]?)?(?:\(\d{2,4}\)[\s\-\.]?|\d{2,4}[\s\-\.])\d{2,4}[\s\-\.]?\d{2,4}(?:[\s\-\.]?\d{2,4})?(?!\d)", "", 70, 0, (), True, first="[0-9(+]"),
    Rule("FAX", "HIPAA", "Fax number", r"\bfax(?:\s*(?:no|number|#))?\s*[:.\-]?\s*(?:\+\d{1,3}[\s\-\.]?)?(?:\(\d{2,4}\)[\s\-\.]?|\d{2,4}[\s\-\.])?\d{2,4}[\s\-\.]?\d{2,4}(?:[\s\-\.]?\d{2,4})?", "i", 75, 0, ("fax",), True, first="[Ff]"),
    Rule("MRN", "HIPAA", "Medical record number", r"\b(?:MRN|medical\s+record\s+(?:no|number|#)|patient\s+(?:id|no|number|#)|hospital\s+(?:no|number|#))\s*[:.\-#]?\s*([A-Z0-9\-]{4,20})", "i", 92, 1, ("mrn", "medical", "patient", "hospital"), first="[MPHmph]"),
    Rule("INSURANCE_ID", "HIPAA", "Health plan beneficiary number", r"\b(?:member\s+id|policy\s+(?:no|number|#)|insurance\s+(?:id|no|number|#)|plan\s+(?:id|no|number|#)|subscriber\s+(?:id|no|number|#)|beneficiary\s+(?:id|no|number|#))\s*[:.\-#]?\s*([A-Z0-9\-]{4,20})", "i", 92, 1, ("member", "policy", "insurance", "plan", "subscriber", "beneficiary"), first="[MPISBmpisb]"),
    Rule("ACCOUNT_NUMBER", "HIPAA", "Account number", r"\b(?:account\s+(?:no|number|#)|acct\s*(?:no|number|#)?)\s*[:.\-#]?\s*([A-Z0-9\-]{4,20})", "i", 88, 1, ("account", "acct"), first="[Aa]"),
    Rule("LICENSE", "HIPAA", "Certificate or licence number", r"\b(?:licen[sc]e|cert(?:ificate)?|registration|DEA|NPI)\s+(?:no|number|#|id)\s*[:.\-#]?\s*([A-Z0-9\-]{4,20})", "i", 88, 1, ("licen", "cert", "registration", "dea", "npi"), first="[LCRDNlcrdn]"),
    Rule("LICENSE", "HIPAA", "Professional registration number", r"\b(?:GMC|NMC|GDC|HCPC|GPhC|GOC|GOsC)\s*(?:pin\s*#?|no\.?|number|reg\.?)?\s*[:.\-#]?\s*([A-Z0-9\-]{5,12})\b", "i", 92, 1, ("gmc", "nmc", "gdc", "hcpc", "gphc", "goc", "gosc"), first="[GNHgnh]"),
    Rule("DEVICE_ID", "HIPAA", "Device identifier", r"\b(?:device\s+(?:id|no|number|#|serial)|serial\s+(?:no|number|#)|UDI|bleep|pager\s*(?:no|number)?)\s*[:.\-#]?\s*([A-Z0-9\-]{2,30})", "i", 88, 1, ("device", "serial", "udi", "bleep", "pager"), first="[DSUBPdsubp]"),
    Rule("VEHICLE_VIN", "HIPAA", "Vehicle VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", "", 85, first="[A-HJ-NPR-Z0-9]"),
    Rule("REFERENCE_ID", "HIPAA", "Reference code", r"\b(?:trust\s+ref(?:erence)?|document\s+(?:id|ref(?:erence)?|no\.?)|referral\s+(?:ref(?:erence)?|no|code)|record\s+(?:ref|id|no)|ref(?:erence)?)\s*[:.\-#]?\s*([A-Z]{2,6}[0-9\-][A-Z0-9\-\.\/]{3,35})\b", "i", 87, 1, ("ref", "document", "record"), first="[TDRtdr]"),
    Rule("POSTCODE_UK", "EU", "UK postcode", r"\b(?:GIR\s?0AA|[A-PR-UWYZ](?:[0-9]{1,2}|[A-HK-Y][0-9]|[A-HK-Y][0-9][0-9ABEHMNPRV-Y]|[0-9][A-HJKPS-UW])\s?[0-9][ABD-HJLNP-UW-Z]{2})\b", "i", 85, 0, (), True, first="[A-PR-UWYZa-pr-uwyz]"),
    Rule("POSTCODE_EU", "EU", "EU postcode (labelled)", r"\b(?:[Pp]ost\s?code|[Pp]ostal\s+code|PLZ|CP|CAP|ZIP)\b\s*[:.\-]?\s*(\d{2}-\d{3}|\d{4}-\d{3}|\d{4}\s?[A-Za-z]{2}|\d{3,5})\b", "", 80, 1, ("post", "plz", "cp", "cap", "zip"), True, first="[PpCZ]"),
    Rule("POSTCODE_US", "HIPAA", "US ZIP code", r"(?<!(?:ISO|IEC|RFC|DIN|ANSI|IEEE|NIST|EN|BS|SP)[\s\/\-])\b\d{5}(?:-\d{4})?\b", "", 60, 0, (), True, first="[0-9]", fast=_ZIP),
    Rule("ADDRESS_LINE", "HIPAA", "Street address", r"\b\d{1,6}\s+\p{Lu}[\p{L}'.\-]*(?:\s+\p{Lu}[\p{L}'.\-]*)*\s+(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Way|Place|Pl\.?|Square|Sq\.?|Crescent|Cres\.?|Close|Terrace|Parade|Causeway|Row|Walk|Grove|Gardens|Mews|Rise|Quay|Wharf|Gate|Green|Hill|View|Park)\b", "u", 78, 0, (), True, first="[0-9]"),
    Rule("DATE", "HIPAA", "Date", rf"\b(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[\/\-\.]\d{{1,2}}[\/\-\.]\d{{2,4}}|\d{{1,2}}\s+{_MONTH}\s+\d{{2,4}}|{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{2,4}})\b", "i", 82, 0, (), True, first="[0-9JFMASONDjfmasond]"),
    Rule("BIOMETRIC", "HIPAA", "Biometric descriptor", r"\b(?:fingerprint|thumbprint|retina(?:l)?\s+scan|iris\s+scan|voice\s+(?:sample|print|recording)|biometric)\b", "i", 70, 0, ("print", "scan", "voice", "biometric"), first="[FTRIVBftrivb]"),
    Rule("NAME", "HIPAA", "Name after an honorific", rf"\b(?:Dr\.?|Prof\.?|Mr\.?|Mrs\.?|Ms\.?|Miss|Sister)[ \t]+({_NAME_WORD}(?:[ \t]+{_NAME_WORD}){{0,2}})\b", "u", 86, 1, ("dr", "prof", "mr", "ms", "miss", "sister"), first="[DPMS]"),
    Rule("NAME", "HIPAA", "Name in a labelled field", rf"\b(?:patient(?:'s)?\s+name|name\s+of\s+patient|next\s+of\s+kin|completed\s+by|on\s+behalf\s+of|signed\s+by|typed\s+by|dictated\s+by|checked\s+by|reported\s+by)\s*[:=\-]?\s*(?:Dr\.?[ \t]+|Prof\.?[ \t]+)?({_NAME_WORD}(?:[ \t]+{_NAME_WORD}){{1,3}})", "iu", 85, 1, ("name", "next", "by", "behalf"), first="[pncostdr]"),
    Rule("NAME", "HIPAA", "Name before a credential", rf"\b({_NAME_WORD}(?:[ \t]+{_NAME_WORD}){{1,3}})[ \t]*,[ \t]*(?:FRCP(?:E|CH)?|MRCP(?:CH)?|FRCPsych|MRCPsych|FRCGP|MRCGP|FRCS|FRCR|FRCOG|RN|RGN|MBChB|MBBS)\b", "u", 84, 1, ("frc", "mrc", "rn", "rgn", "mb"), first="[abdeltv\\p{Lu}]", anywhere=True),
    Rule("NAME", "HIPAA", "Name after a staff role", rf"\b(?:specialist\s+nurse|heart\s+failure\s+nurse|clinical\s+nurse|charge\s+nurse|ward\s+sister|caldicott\s+guardian|named\s+nurse|clinical\s+lead|case\s+coordinator|(?:medical\s+)?secretary)[ \t]*[:.\-]?[ \t]*(?:Dr\.?[ \t]+)?({_NAME_WORD}(?:[ \t]+{_NAME_WORD}){{0,2}})\b", "iu", 83, 1, ("nur", "ter", "guardian", "lead", "coordinator", "cretary"), first="[shcwnm]"),
    Rule("NAME", "HIPAA", "Name after a relation", rf"\b(?:his|her|their)[ \t]+(?:wife|husband|partner|daughter|son|mother|father|brother|sister|carer|guardian)[ \t]*,?[ \t]*(?:Dr\.?[ \t]+|Mrs?\.?[ \t]+|Ms\.?[ \t]+)?({_NAME_WORD}(?:[ \t]+{_NAME_WORD}){{0,2}})\b", "iu", 83, 1, ("wife", "band", "partner", "daughter", "on", "other", "father", "ter", "carer", "guardian"), first="[ht]"),
    Rule("NAME", "HIPAA", "Name in raw FHIR JSON", r'"(?:family|maidenName|prefix|suffix)"\s*:\s*"([^"\n]{1,60})"|"given"\s*:\s*\[([^\]\n]{1,200})\]|"given"\s*:\s*"([^"\n]{1,60})"', "", 86, 3, ('"family"', '"maidenname"', '"prefix"', '"suffix"', '"given"')),
    Rule("RARE_DISEASE_ICD", "QUASI", "ICD-10 code of a rare disease", r"\b[A-TV-Z][0-9][A-Z0-9](?:\.[A-Z0-9]{1,4})?\b", "", 40, 0, (), True, first="[A-TV-Z]"),
    Rule("INSTITUTION", "QUASI", "Treating institution", r"\b(?:[A-Z][a-z]+\s+){0,4}(?:Hospitals?|Clinic|Medical\s+Centers?|Medical\s+Centres?|Infirmary|NHS\s+(?:Trust|Greater\s+\w+(?:\s+and\s+\w+)?|Lothian|Borders)|Health(?:\s+(?:System|Network|Trust))?|Healthcare|Memorial|UMC|University\s+Medical\s+Center|Universit(?:ätsmedizin|y\s+Hospitals?)|Charit[éeè]|General\s+Hospital)\b", "", 50, 0, ("hospital", "clinic", "medical", "infirmary", "nhs", "health", "memorial", "umc", "universit", "charit"), first="[A-Z]"),
    Rule("ETHNICITY", "QUASI", "Ethnicity", r"\b(?:White|Black|Asian|Hispanic|Latino|Latina|Latinx|Caucasian|African[\s\-]?American|Native[\s\-]?American|Pacific[\s\-]?Islander|Mixed[\s\-]?race|Arab|Indigenous)\b", "i", 45, 0, ("white", "black", "asian", "hispanic", "latin", "american", "islander", "race", "arab", "indigenous"), first="[WBAHLCNPMIwbahlcnpmi]"),
    Rule("OCCUPATION", "QUASI", "Occupation", r"\b(?:occupation|job|profession|employed\s+as)[ \t]*[:.\-]?[ \t]*([A-Za-z][A-Za-z \t\-]{2,40})", "i", 55, 1, ("occupation", "job", "profession", "employed"), first="[OJPEojpe]"),
    Rule("AGE_OVER_89", "HIPAA", "Age over 89", r"\b(?:age(?:d)?\s*[:.\-]?\s*(\d{2,3})|(\d{2,3})\s*(?:y\.?o\.?\b|years?\s+old\b|years?\s+of\s+age\b))", "i", 30, 2, ("age", "y"), True, first="[Aa0-9]"),
)
#: Lower-case words that may lead into a name.
PARTICLES = ("al", "el", "bin", "binti", "van", "von", "der", "den", "de", "del", "della", "di", "da", "ter", "ten", "la", "le")
#: Heads of ICD-10 codes that count as rare (tier ``flag``) where no catalogue is given.
STARTER_HEADS = (
    "E70", "E71", "E72", "E74", "E75", "E76", "E77", "E78", "E79", "E80", "E83", "E84", "E85", "E88",
    "G10", "G11", "G12", "G23", "G24", "G35", "G36", "G37", "G60", "G61", "G71", "G72",
    "D55", "D56", "D57", "D58", "D59", "D60", "D61", "D66", "D67", "D68", "D69",
    "Q00", "Q01", "Q02", "Q03", "Q04", "Q05", "Q06", "Q07", "Q77", "Q78", "Q79", "Q87", "Q90", "Q91", "Q92", "Q93", "Q95", "Q96", "Q97", "Q98", "Q99",
    "C81", "C82", "C83", "C84", "C85", "C88", "C91", "C92", "C93", "C94", "C95", "C96",
)
STRONG = ("NAME", "MRN", "NHS_NUMBER", "SSN", "UK_NINO", "NATIONAL_ID_DK_CPR", "NATIONAL_ID_NL_BSN", "NATIONAL_ID_ES", "NATIONAL_ID_IT_CF", "NATIONAL_ID_CH_AHV", "PASSPORT", "IBAN", "INSURANCE_ID", "ACCOUNT_NUMBER")
HIGH = (*STRONG, "RARE_DISEASE_ICD", "BIOMETRIC")
MEDIUM = ("EMAIL", "PHONE", "FAX", "DATE", "ADDRESS_LINE", "POSTCODE_UK", "POSTCODE_US", "POSTCODE_EU", "INSTITUTION", "OCCUPATION", "ETHNICITY", "DEVICE_ID", "REFERENCE_ID", "LICENSE")
SENSITIVE = ("RARE_DISEASE_ICD", "ETHNICITY")
QUASI = ("RARE_DISEASE_ICD", "INSTITUTION", "ETHNICITY", "OCCUPATION")
MANUAL = ("NAME", "DATE", "ADDRESS_LINE", "PHONE", "EMAIL", "MRN", "SSN", "REFERENCE_ID", "POSTCODE_UK", "INSTITUTION", "OCCUPATION")

#: Of several rules with one label the first gives its priority.
PRIORITY: dict[str, int] = {}
for _r in RULES:
    PRIORITY.setdefault(_r.label, _r.priority)
#: Of labels without a rule, and of numbers of the NHS shape that fail their check digit.
OTHER_PRIORITY, FAILED_NHS_PRIORITY = 50, 65
