from xml.sax.saxutils import escape

from redactum.plans import catalogue as cat

CLASSES = [*cat.PER_MILLION, "Unknown"]


def xml_files(folder, n):
    """Both published files, of n disorders, some without codes or classes; with what else stands in them."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<JDBOR date="2026-01-01" version="1">\n<DisorderList count="%d">\n' % n
    align, prev = [head], [head]
    for i in range(n):
        codes = [f"{chr(65 + i % 26)}{i % 90 + 10}.{i % 10}"] * (i % 5 > 0) + [f"G{i % 80 + 10}"] * (i % 7 == 0)
        refs = "".join(f'<ExternalReference id="{i}{j}"><Source>ICD-10</Source><Reference>{c}</Reference><Mapping id="1"><Name lang="en">E (Exact)</Name></Mapping></ExternalReference>' for j, c in enumerate(codes))
        align.append(f'<Disorder id="{i}"><OrphaCode>{i}</OrphaCode><Name lang="en">Disorder &amp; {i}</Name><ExternalReferenceList count="{len(codes)}"><ExternalReference id="x"><Source>OMIM</Source><Reference>G40.5</Reference></ExternalReference>{refs}</ExternalReferenceList></Disorder>\n')
        classes = [CLASSES[i % 6], CLASSES[(i // 6) % 6]][: i % 3]
        ways = "".join(f'<Prevalence id="{i}{j}"><Source>x</Source><PrevalenceClass id="1"><Name lang="en">{escape(c)}</Name></PrevalenceClass><ValMoy>0.0</ValMoy></Prevalence>' for j, c in enumerate(classes))
        prev.append(f'<Disorder id="{i}">\n<OrphaCode>{i}</OrphaCode>\n<PrevalenceList count="{len(classes)}">{ways}</PrevalenceList></Disorder>\n')
    for name, parts in (("align.xml", align), ("prev.xml", prev)):
        (folder / name).write_text("".join(parts) + "</DisorderList>\n</JDBOR>\n", encoding="utf-8")


def expected(n):
    tiers = {}
    for i in range(n):
        codes = [f"{chr(65 + i % 26)}{i % 90 + 10}.{i % 10}"] * (i % 5 > 0) + [f"G{i % 80 + 10}"] * (i % 7 == 0)
        known = [cat.PER_MILLION[c] for c in [CLASSES[i % 6], CLASSES[(i // 6) % 6]][: i % 3] if c in cat.PER_MILLION]
        if known and min(known) <= cat.FLAG_LIMIT:
            for c in codes:
                tiers[c] = min(tiers.get(c, "flag"), "auto" if min(known) <= cat.AUTO_LIMIT else "flag")
    return tiers


def test_published_files_are_read_in_ranges(spark, tmp_path):
    n = 16_000
    xml_files(tmp_path, n)
    assert (tmp_path / "align.xml").stat().st_size > 4 << 20
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        aligned, prevalent = cat.read_alignments(spark, str(tmp_path / "align.xml")), cat.read_prevalences(spark, str(tmp_path / "prev.xml"))
        assert aligned.rdd.getNumPartitions() > 8
        assert cat.as_mapping(cat.build_catalogue(aligned, prevalent)) == expected(n)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
