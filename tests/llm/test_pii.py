"""Personal information: every written form, what only looks like it, and exact places."""

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import pii


def found(t):
    return [(k, t[s:e]) for k, s, e in pii.find(t)]


@pytest.mark.parametrize(
    "kind, value, text",
    [
        ("email", "a.b+sim@mail.example.com", "Send it to a.b+sim@mail.example.com."),
        ("email", "x-y[at]dept[dot]lab[dot]example", "reply-to=x-y[at]dept[dot]lab[dot]example;"),
        ("email", "KIM @ OTA.INVALID", "To: KIM @ OTA.INVALID\nSubject"),
        ("email", "jo47 (at) ota.invalid", "user jo47 (at) ota.invalid locked the cell"),
        ("phone", "+49 (0)30 23125-060", "tel +49 (0)30 23125-060 The"),
        ("phone", "0049 30 23125395", "Call 0049 30 23125395 if"),
        ("phone", "020 7946 0452", "It rang twice (020 7946 0452) before"),
        ("phone", "(617) 555-0158", "T (617) 555-0158\n"),
        ("phone", "2025550199", "T 2025550199"),
        ("phone", "+33.1.99.00.77.62", "fax/+33.1.99.00.77.62/mobile off"),
        ("phone", "030/23125 734", "contact,030/23125 734,lab 2"),
        ("phone", "415-555-0161 ext. 40", "| 415-555-0161 ext. 40 |"),
        ("id_number", "993-28-4270", "SSN 993-28-4270"),
        ("id_number", "QQ 83 67 03 C", "The guard wrote QQ 83 67 03 C on the sheet."),
        ("id_number", "P3432<8560", "scan of P3432<8560 attached"),
        ("id_number", "L6X38K4139", "reference L6X38K4139 signed"),
        ("id_number", "05.256.180-X", "passport: 05.256.180-X"),
        ("id_number", "000120/4780", "ID 000120/4780."),
        ("address", "1642 Tindle Road, Apt 3B, Marrowdale", "rig to 1642 Tindle Road, Apt 3B, Marrowdale last spring"),
        ("address", "2134 N. Tindle Dr", "went to 2134 N. Tindle Dr by courier"),
        ("address", "1927 Mossfell Lane\nTessbrook 30794", "lab at 1927 Mossfell Lane\nTessbrook 30794 keeps"),
        ("address", "Osterfenstraße 23, 45986 Orlingham", "lab at Osterfenstraße 23, 45986 Orlingham keeps"),
        ("address", "Venner Str. 37a, D-50895 Neu-Ellbach", "at Venner Str. 37a, D-50895 Neu-Ellbach."),
        ("address", "14 bis, rue de Cinderby, 60419 Tessbrook", "went to 14 bis, rue de Cinderby, 60419 Tessbrook"),
        ("address", "Calle Pellow 1, 2º B, 18634 Orlingham", "point, Calle Pellow 1, 2º B, 18634 Orlingham, closes"),
        ("address", "PO Box 1126, Orlingham", "went to PO Box 1126, Orlingham by courier"),
        ("address", "Unit 18, 1007-1011 Osterfen Street, Tessbrook", "to Unit 18, 1007-1011 Osterfen Street, Tessbrook."),
        ("person", "Mira de Quartravik", "It is owned by Mira de Quartravik, not"),
        ("person", "Rafe R. Ruvfelvik-Holt", "According to Dr. Rafe R. Ruvfelvik-Holt the bias"),
        ("person", "RAFE NADFELNGO", "thx RAFE NADFELNGO, will"),
        ("person", "Sarah Whitfield", "Please contact Sarah Whitfield today"),
        ("person", "Kwame Mensah", "Kwame Mensah will attend"),
        ("person", "W. Harbrasande", "to 5.2 V, later W. Harbrasande and the group"),
        ("person", "Brenquivik, Rafe", "Reviewed by Brenquivik, Rafe and the group"),
        ("person", "Xerxes Harbrane", "Reviewed by Xerxes Harbrane."),
        ("person", "Jonas al-Lomloska", "@Jonas al-Lomloska please look"),
    ],
)
def test_forms(kind, value, text):
    assert found(text) == [(kind, value)]


@pytest.mark.parametrize(
    "text",
    ["uses @m85[gm] and v(out)@27 as probes", "Row 20 Cascode Lane of the floorplan", "Street level noise was below 17 uV", "Checkpoint step 2288855 of 20000000 finished.", "from 2025-03-15 10:06:36 onward", "Order code ZQ-6178-18 is obsolete", "The value 0.44564456 came", "Early voltage and Monte Carlo spread", "Project Selwyn Ridge keeps", "Lot 2222-118-4512 was scrapped", "Model card rev 5.1.2-9572 applies", "A Schmitt trigger, the Bode plot and Miller compensation", "Netlist hash 2f84a2c2746da74", "29.13 mS. With Miller compensation", "Order number 9876543210 came", "the Julia Set and the Analog Platform Group", "to 16.83 V. The dynamic load", "Die Stromquelle im Protokoll", ""],
)
def test_look_alikes(text):
    assert found(text) == []


def test_lists_tables_and_signatures():
    t = "Attendees: ILSE MORWENHOLT; Brenquivik, Rafe; J. Holt\n| contact | phone | badge |\n| Gil Ost | 2025550199 | 993-28-4270 |\n\n--\nWen Grulomoor\nGroup\nwen.grulomoor@ota.invalid"
    assert [v for _, v in found(t)] == ["ILSE MORWENHOLT", "Brenquivik, Rafe", "J. Holt", "Gil Ost", "2025550199", "993-28-4270", "Wen Grulomoor", "wen.grulomoor@ota.invalid"]


def test_places_survive_odd_letters():
    t = "İİ ſ 😀 Reviewed by Mira Holt."
    assert found(t) == [("person", "Mira Holt")] and pii.find(t)[0][1] == t.index("Mira")


def test_given_names_are_learned_and_terms_are_not(spark):
    """Names known from headers are found in any sentence and in small letters; a pair that is always the same is a term."""
    rows = [(i, f"From: Ottilie Brae{chr(97 + i)} <x@a.example>\nnone") for i in range(6)]
    rows += [(20, "yesterday ottilie braemar measured it again"), (21, "then Braemar, Ottilie and we"), (22, "a report by Quirin Vant only"), (23, "OTTILIE VANCE asked")]
    rows += [(30 + i, "we used the Hartmann Kessel rig") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r.doc_id, r.start_pos) for r in pii.findings(df).filter("pii_type = 'person'").collect()}
    assert got == {(i, 6) for i in range(6)} | {(20, 10), (21, 5), (22, 12), (23, 0)}
    assert {r.redacted for r in pii.redacted(df).filter("doc_id = 20 or doc_id = 30").collect()} == {"yesterday [PERSON] measured it again", "we used the Hartmann Kessel rig"}


def test_common_words_are_no_given_names(spark):
    """A given name that is mostly a word in small letters counts only where it is written as a name."""
    rows = [(i, f"Reviewed by Will Harper{chr(97 + i)}.") for i in range(3)] + [(10 + i, "this will surely rise") for i in range(9)]
    got = {r.doc_id for r in pii.findings(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {0, 1, 2}


def test_operator(spark):
    rows = [(1, "Reviewed by Mira Holt.", 5), (1, "Reviewed by Mira Holt.", 5), (2, None, 5), (3, "", 5), (4, "x " * 200_000 + "a@b.example", 5), (None, "T 2025550199", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_pos int").withColumn("findings", F.lit("clash"))
    got = sorted(map(tuple, pii.findings(df).collect()), key=str)
    assert got == sorted([(1, "person", 12), (1, "person", 12), (4, "email", 400_000), (None, "phone", 2)], key=str)
    red = {r.doc_id: r.redacted for r in pii.redacted(df).collect()}
    assert red[1] == "Reviewed by [PERSON]." and red[2] is None and red[3] == ""
    assert pii.findings(df.limit(0)).count() == 0


def test_redaction_keeps_the_rest():
    t = "Call 0049 30 23125395 or mail a@b.example."
    assert pii.redact(t, pii.find(t)) == "Call [PHONE] or mail [EMAIL]."
