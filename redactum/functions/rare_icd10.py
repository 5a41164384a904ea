"""Tiers of ICD-10 codes of rare diseases: ``auto`` up to 1 in 100,000, ``flag`` up to 1 in 10,000.

The table was taken over as it is from the catalogue that results have to agree with;
nothing here computes it. That catalogue was generated on 2026-05-12 from Orphadata of
Orphanet (INSERM US14, licensed under CC BY 4.0): alignments
(https://www.orphadata.com/data/xml/en_product1.xml) and prevalences
(https://www.orphadata.com/data/xml/en_product9_prev.xml). ``plans/catalogue.py`` builds
one anew from those files; every flow takes another catalogue as a parameter.
"""

# Code and tier, by code.
_TABLE = """
A01.0 auto  A03.0 auto  A03.1 auto  A03.2 auto  A03.3 auto  A03.8 auto  A03.9 auto  A05.1 auto  A15 flag  A16 flag
A20.0 flag  A20.1 flag  A20.2 flag  A20.3 flag  A20.7 flag  A20.8 flag  A20.9 flag  A21.0 auto  A21.1 auto  A21.2 auto
A21.3 auto  A21.7 auto  A21.8 auto  A21.9 auto  A23.0 auto  A23.1 auto  A23.2 auto  A23.3 auto  A23.8 auto  A23.9 auto
A27.0 auto  A27.8 auto  A27.9 auto  A28.1 flag  A30.0 flag  A30.1 flag  A30.2 flag  A30.3 flag  A30.4 flag  A30.5 flag
A30.8 flag  A30.9 flag  A31.0 flag  A32.0 auto  A32.1 auto  A32.7 auto  A32.8 auto  A32.9 auto  A33 auto  A34 auto
A35 auto  A37.0 auto  A37.1 auto  A37.8 auto  A37.9 auto  A39.0 auto  A43.0 auto  A43.1 auto  A43.8 auto  A43.9 auto
A48.1 auto  A48.3 auto  A50.0 auto  A50.1 auto  A50.2 auto  A50.3 auto  A50.4 auto  A50.5 auto  A50.6 auto  A75.3 auto
A77.0 auto  A77.1 flag  A78 auto  A81.0 auto  A81.1 flag  A81.2 auto  A82.0 auto  A82.1 auto  A82.9 auto  A83.0 auto
A83.1 auto  A83.3 auto  A83.5 flag  A92.0 auto  A92.3 auto  A97.0 auto  A97.1 auto  A97.2 auto  A97.9 auto  A98.5 auto
B00.4 auto  B02.2 flag  B18.0 flag  B18.2 flag  B37.8 flag  B47.0 flag  B47.1 flag  B47.9 flag  B48.7 auto  B50.0 auto
B50.8 auto  B50.9 auto  B51.0 auto  B51.8 auto  B51.9 auto  B52.0 auto  B52.8 auto  B52.9 auto  B53.0 auto  B53.1 auto
B53.8 auto  B54 auto  B55.0 auto  B55.1 auto  B55.2 auto  B55.9 auto  B57.0 auto  B57.1 auto  B57.2 auto  B57.3 auto
B57.4 auto  B57.5 auto  B60.1 flag  B60.2 flag  B67.0 flag  B67.1 flag  B67.2 flag  B67.3 flag  B67.4 flag  B67.5 auto
B67.6 auto  B67.7 auto  B67.8 flag  B67.9 flag  B70.0 auto  B75 auto  B81.0 auto  B83.0 flag  C00.1 flag  C06.9 flag
C07 auto  C08.0 auto  C08.1 auto  C08.8 auto  C10.8 flag  C11.0 auto  C11.1 auto  C11.2 auto  C11.3 auto  C12 flag
C13.0 flag  C13.2 flag  C13.8 flag  C15.0 auto  C15.1 auto  C15.2 auto  C15.3 auto  C15.4 auto  C15.5 auto  C15.8 auto
C16.0 auto  C16.1 auto  C16.2 auto  C16.3 auto  C16.4 auto  C16.5 auto  C16.6 auto  C16.8 auto  C16.9 auto  C17.9 auto
C18.0 auto  C18.2 auto  C18.3 auto  C18.4 auto  C18.5 auto  C18.6 auto  C18.7 auto  C18.8 auto  C18.9 auto  C20 auto
C21.1 auto  C22.0 auto  C22.1 auto  C22.7 auto  C23 auto  C24.0 auto  C24.1 auto  C24.8 auto  C24.9 auto  C25 auto
C25.4 auto  C26.9 flag  C32.8 flag  C34.1 auto  C34.2 auto  C34.3 auto  C34.8 auto  C34.9 auto  C40.0 auto  C40.1 auto
C40.2 auto  C40.3 auto  C41.2 auto  C41.3 auto  C41.4 auto  C41.9 auto  C43.0 flag  C43.1 flag  C43.2 flag  C43.3 flag
C43.4 flag  C43.5 flag  C43.6 flag  C43.7 flag  C43.8 flag  C43.9 auto  C44.3 auto  C44.6 auto  C44.7 auto  C44.9 auto
C45.0 auto  C45.1 auto  C46.0 auto  C46.1 auto  C46.2 auto  C46.3 auto  C46.7 auto  C46.8 auto  C46.9 auto  C47.9 flag
C49.9 auto  C50.0 auto  C50.1 auto  C50.2 auto  C50.3 auto  C50.4 auto  C50.5 auto  C50.6 auto  C50.8 auto  C51.8 auto
C52 auto  C53.0 auto  C53.1 auto  C53.8 auto  C54.1 auto  C56 auto  C57.0 auto  C60 auto  C60.0 auto  C60.1 auto
C60.2 auto  C60.8 auto  C60.9 auto  C61 flag  C62.1 flag  C62.9 flag  C64 auto  C65 flag  C66 flag  C67.0 auto
C67.1 auto  C67.2 auto  C67.3 auto  C67.4 auto  C67.5 auto  C67.6 auto  C67.7 auto  C67.8 auto  C67.9 auto  C69.2 auto
C69.3 auto  C71.6 auto  C71.7 auto  C71.9 auto  C73 auto  C74.0 auto  C74.1 auto  C74.9 flag  C75.0 auto  C75.1 auto
C75.5 auto  C78.6 auto  C81.0 auto  C81.1 auto  C81.2 auto  C81.3 auto  C81.4 auto  C81.7 auto  C81.9 auto  C82.0 auto
C82.1 auto  C82.2 auto  C82.3 auto  C82.4 auto  C82.5 auto  C82.6 auto  C82.7 auto  C82.9 auto  C83.0 auto  C83.1 auto
C83.3 auto  C83.7 auto  C84.0 auto  C84.6 flag  C84.7 flag  C85.2 flag  C86.0 flag  C86.2 auto  C86.6 auto  C88.0 auto
C88.4 auto  C90.0 flag  C90.2 auto  C90.3 auto  C91.0 flag  C91.1 flag  C91.4 auto  C91.5 flag  C91.7 auto  C91.8 auto
C92.0 flag  C92.1 flag  C92.4 auto  C92.5 auto  C93.0 auto  C93.1 auto  C93.3 auto  C96.0 flag  C96.2 auto  C96.5 flag
C96.6 flag  C97 flag  D02.3 auto  D10.6 auto  D12.6 auto  D13.7 auto  D15.0 auto  D22.3 flag  D22.4 flag  D22.5 flag
D22.6 flag  D22.7 flag  D22.9 flag  D32.9 flag  D33.2 auto  D33.3 auto  D33.4 auto  D33.7 auto  D35.0 auto  D35.2 auto
D35.6 auto  D36.1 flag  D37.0 flag  D37.3 auto  D37.7 auto  D38.4 auto  D39.2 auto  D40.1 auto  D43.2 auto  D44.4 auto
D44.8 flag  D45 flag  D46.2 auto  D46.7 auto  D47.0 flag  D47.1 auto  D47.2 auto  D47.3 auto  D47.4 flag  D47.7 auto
D48.0 auto  D48.1 auto  D48.7 auto  D51.1 auto  D55.2 auto  D56.0 auto  D56.1 auto  D58.2 flag  D58.8 flag  D59.1 auto
D59.3 auto  D59.5 auto  D59.6 auto  D61.0 auto  D61.3 auto  D64.3 flag  D64.4 auto  D66 auto  D67 auto  D68.0 auto
D68.1 auto  D68.2 auto  D68.4 auto  D68.5 auto  D68.8 auto  D69.0 flag  D69.1 auto  D69.3 auto  D69.4 auto  D70 auto
D71 auto  D76.1 auto  D80.0 auto  D81.1 flag  D81.2 auto  D81.3 auto  D81.8 flag  D82.0 auto  D82.1 flag  D82.4 auto
D82.8 auto  D84.1 flag  D84.8 auto  D86.0 auto  D86.1 auto  D86.2 auto  D86.3 auto  D86.8 auto  D86.9 auto  D89.1 flag
E03.0 flag  E03.1 flag  E06.5 flag  E07.1 flag  E07.8 flag  E16.4 auto  E20.1 auto  E20.8 auto  E22.0 auto  E22.8 flag
E23.0 auto  E23.2 flag  E24.0 auto  E25.0 auto  E26.8 auto  E27.1 auto  E29.1 auto  E31.0 auto  E34.3 auto  E34.5 auto
E34.8 auto  E53.8 auto  E70.0 auto  E70.1 auto  E70.2 auto  E70.3 auto  E70.8 auto  E71.0 auto  E71.1 auto  E71.3 auto
E72.0 auto  E72.1 auto  E72.2 auto  E72.3 auto  E72.4 auto  E72.5 auto  E74.0 auto  E74.1 auto  E74.2 auto  E74.3 auto
E74.4 auto  E74.8 auto  E75.0 auto  E75.1 auto  E75.2 auto  E75.4 auto  E75.5 auto  E76.0 auto  E76.1 auto  E76.2 auto
E77.0 auto  E77.1 auto  E77.8 auto  E78.0 auto  E78.2 flag  E78.3 auto  E79.1 auto  E79.8 flag  E80.0 auto  E80.1 auto
E80.2 auto  E80.3 flag  E80.5 auto  E83.0 auto  E83.1 auto  E83.2 auto  E83.3 flag  E83.5 flag  E84 auto  E84.0 auto
E84.1 auto  E84.8 auto  E85.0 auto  E85.1 auto  E85.3 flag  E85.4 auto  E85.9 auto  E88.0 flag  E88.1 auto  E88.8 auto
F45.2 auto  F53.1 flag  F80.3 auto  F84.2 flag  F84.3 flag  G01 auto  G04.0 auto  G04.8 auto  G05.1 auto  G08 auto
G10 auto  G11.1 auto  G11.2 auto  G11.3 auto  G11.4 auto  G11.8 auto  G12.0 auto  G12.1 auto  G12.2 auto  G20 flag
G23.0 auto  G23.1 auto  G23.2 auto  G23.3 auto  G24.1 auto  G24.8 auto  G25.8 auto  G30.0 flag  G31.0 auto  G31.8 auto
G36.0 auto  G37.3 auto  G40.0 auto  G40.3 auto  G40.4 auto  G40.5 auto  G40.8 auto  G44.8 flag  G47.3 auto  G47.4 auto
G47.8 auto  G50.0 flag  G50.1 flag  G51.0 flag  G51.8 auto  G52.1 auto  G53.0 flag  G54.5 flag  G60.0 flag  G60.1 auto
G60.2 auto  G60.8 auto  G61.0 auto  G61.8 auto  G70.0 auto  G70.2 auto  G71.0 auto  G71.1 auto  G71.2 auto  G71.3 auto
G71.8 flag  G72.3 auto  G73.1 auto  G80.8 flag  G90.5 flag  G90.6 auto  G90.8 auto  G93.8 flag  G96.0 flag  G98 auto
H15.0 flag  H16.3 flag  H18.5 auto  H19.2 flag  H20.8 auto  H30.1 auto  H30.8 auto  H31.0 auto  H31.2 flag  H34.1 flag
H35.5 auto  H40.1 flag  H44.1 auto  H47.2 auto  H49.8 auto  H53.5 flag  H57.0 flag  I00 flag  I01.0 flag  I01.1 flag
I01.2 flag  I01.8 flag  I01.9 flag  I26.0 flag  I27.0 auto  I27.2 auto  I33.0 flag  I42.0 flag  I42.8 flag  I45.8 auto
I47.1 auto  I47.2 auto  I67.5 auto  I67.6 auto  I67.7 auto  I67.8 flag  I71.0 auto  I73.8 auto  I77.8 auto  I78.0 flag
I81 auto  I82.0 auto  I82.8 auto  I89.8 flag  I97.8 flag  J47 flag  J80 flag  J81 auto  J82 auto  J84.0 auto
J84.1 auto  J98.8 auto  K00.5 flag  K06.8 auto  K22.0 auto  K52.8 auto  K55.0 auto  K62.6 flag  K66.2 auto  K74.3 auto
K75.4 auto  K76.8 auto  K83.0 auto  K86.1 auto  K90.8 auto  K91.8 flag  L10.0 auto  L10.1 auto  L10.2 flag  L10.3 auto
L10.8 auto  L12.0 flag  L12.1 auto  L12.3 auto  L12.8 auto  L13.0 auto  L27.0 auto  L40.1 auto  L40.2 flag  L51.1 auto
L51.2 auto  L56.3 flag  L56.4 auto  L81.8 flag  L88 auto  L90.5 auto  L93.0 flag  L93.1 auto  L93.2 auto  L94.0 flag
L95.0 flag  M02.3 flag  M06.1 auto  M08.0 flag  M08.2 auto  M08.3 flag  M08.8 flag  M14.8 auto  M30.0 auto  M30.1 auto
M31.0 auto  M31.1 auto  M31.3 auto  M31.4 auto  M31.6 auto  M31.7 auto  M32.0 auto  M32.1 auto  M32.8 auto  M32.9 auto
M33.0 auto  M33.1 auto  M33.2 auto  M34.0 flag  M34.1 flag  M34.2 flag  M34.8 flag  M34.9 flag  M35.0 flag  M35.1 auto
M35.2 auto  M35.4 flag  M35.8 auto  M60.8 auto  M61.1 auto  M86.3 auto  M87.8 flag  M91.1 flag  M92.2 flag  M93.1 flag
M94.1 auto  N03.5 auto  N03.6 auto  N04.2 auto  N04.8 auto  N08.0 auto  N08.5 auto  N15.8 flag  N16.3 auto  N25.1 auto
N25.8 auto  N30.1 auto  N48.3 flag  N61 flag  O90.3 flag  P24.0 flag  P28.4 flag  P29.1 flag  P35.0 auto  P35.2 flag
P37.1 flag  P57.8 auto  P70.2 auto  P72.2 flag  P78.3 auto  P91.6 flag  Q00.0 auto  Q02 auto  Q03.0 flag  Q03.1 flag
Q04.0 auto  Q04.2 auto  Q04.3 auto  Q04.6 flag  Q04.8 auto  Q05.9 flag  Q13.1 flag  Q13.8 auto  Q14.1 flag  Q15.0 auto
Q17.2 flag  Q20.0 flag  Q20.2 auto  Q20.4 flag  Q20.5 flag  Q21.1 flag  Q21.4 flag  Q22.1 flag  Q22.4 flag  Q22.5 auto
Q22.6 auto  Q23.4 flag  Q24.6 flag  Q24.8 auto  Q25.1 auto  Q25.3 flag  Q25.4 auto  Q25.7 auto  Q26.2 flag  Q26.5 flag
Q26.8 flag  Q28.2 flag  Q28.8 auto  Q30.0 flag  Q31.8 flag  Q32.1 flag  Q32.4 flag  Q33.0 auto  Q33.6 flag  Q33.8 flag
Q34.8 flag  Q35 flag  Q38.0 auto  Q38.2 flag  Q39.0 flag  Q39.1 flag  Q39.2 flag  Q39.3 flag  Q40.2 flag  Q41.0 flag
Q41.1 flag  Q41.2 flag  Q41.8 flag  Q41.9 flag  Q42.9 flag  Q43.1 flag  Q43.4 auto  Q44.2 flag  Q44.4 flag  Q44.6 auto
Q44.7 auto  Q45.1 auto  Q51.8 flag  Q55.0 flag  Q56.0 flag  Q60.1 auto  Q61.1 flag  Q61.5 auto  Q61.9 flag  Q64.0 flag
Q64.1 auto  Q64.2 flag  Q64.4 flag  Q67.4 flag  Q68.8 flag  Q71.1 auto  Q71.4 flag  Q71.5 auto  Q72.4 flag  Q72.5 auto
Q72.6 flag  Q73.8 auto  Q74.0 auto  Q74.2 flag  Q74.3 flag  Q74.8 auto  Q75.0 auto  Q75.1 auto  Q75.4 auto  Q75.8 flag
Q76.0 flag  Q76.1 auto  Q76.7 flag  Q77.0 flag  Q77.1 flag  Q77.2 auto  Q77.3 auto  Q77.4 flag  Q77.5 auto  Q77.6 auto
Q77.7 auto  Q77.8 auto  Q78.0 auto  Q78.1 auto  Q78.2 auto  Q78.4 flag  Q78.6 auto  Q78.8 auto  Q79.0 flag  Q79.2 flag
Q79.3 flag  Q79.4 auto  Q79.6 auto  Q79.8 flag  Q80.1 flag  Q80.2 auto  Q80.3 auto  Q80.8 auto  Q81.0 auto  Q81.1 auto
Q81.2 auto  Q82.0 flag  Q82.1 auto  Q82.3 auto  Q82.4 auto  Q82.8 auto  Q84.8 flag  Q85.0 auto  Q85.1 flag  Q85.8 auto
Q86.0 auto  Q86.8 auto  Q87.0 auto  Q87.1 auto  Q87.2 auto  Q87.3 auto  Q87.4 flag  Q87.8 auto  Q89.3 flag  Q89.4 auto
Q89.7 auto  Q91.0 auto  Q91.1 auto  Q91.2 auto  Q91.3 auto  Q91.4 auto  Q91.5 auto  Q91.6 auto  Q91.7 auto  Q92.2 flag
Q92.3 auto  Q92.8 flag  Q93.2 flag  Q93.3 flag  Q93.4 flag  Q93.5 auto  Q93.8 flag  Q96.0 flag  Q96.1 flag  Q96.2 flag
Q96.3 flag  Q96.4 flag  Q96.8 flag  Q96.9 flag  Q98.1 auto  Q98.8 flag  Q99.1 flag  Q99.2 auto  Q99.8 auto  R04.8 flag
T09.3 flag  T40.5 flag  T45.1 flag  T50.4 auto  T56.0 auto  T56.1 flag  T63.0 flag  T66 auto  T86.0 flag  T86.8 flag
Y14 flag  Z94.8 auto
"""
_WORDS = _TABLE.split()
RARE_CODES = dict(zip(_WORDS[::2], _WORDS[1::2], strict=True))
