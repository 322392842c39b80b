import pytest

from corpusloom.llm import personal as P

FOUND = [
    ("Write to ada.lark@post.example today", [("email", "ada.lark@post.example")]), ("mail ada (at) post.example or bo [at] post [dot] example", [("email", "ada (at) post.example"), ("email", "bo [at] post [dot] example")]), ("ada dot lark at post dot example", [("email", "ada dot lark at post dot example")]),
    ("Call +49 171 39200 26 now", [("phone", "+49 171 39200 26")]), ("tel: (544) 555-0191 ext. 12", [("phone", "(544) 555-0191 ext. 12")]), ("My number is 5295550138, thanks", [("phone", "5295550138")]), ("Tél. : 06.39.98.77.96", [("phone", "06.39.98.77.96")]),
    ("The fixture had SSN 935-43-1394 in it", [("id_number", "935-43-1394")]), ("DNI 04648502A, bitte", [("id_number", "04648502A")]), ("Steuer-ID: 23 213 604 382", [("id_number", "23 213 604 382")]), ("numéro de sécurité sociale 2 71 54 99 231 491 23 figure", [("id_number", "2 71 54 99 231 491 23")]), ("passport no. C0GF28162 was", [("id_number", "C0GF28162")]),
    ("Ship it to Flat 3, 2 Saltmarsh Road, Vallenne 12345.", [("address", "Flat 3, 2 Saltmarsh Road")]), ("to PO Box 44, Vallenne", [("address", "PO Box 44")]), ("Anschrift: Am Millraceplatz 49", [("address", "Am Millraceplatz 49")]), ("portable au 18 rue de Saltmarsh, 82946 K", [("address", "18 rue de Saltmarsh")]), ("a Calle Windlass 195, 2º B", [("address", "Calle Windlass 195")]),
    ("Thanks to Ada Q. Lark-Bow for spotting it", [("person", "Ada Q. Lark-Bow")]), ("Reviewed by LARK, Ada, who", [("person", "LARK, Ada")]), ("Thanks to ada larkovic for it", [("person", "ada larkovic")]), ("Hi Ayşe, could you", [("person", "Ayşe")]), ("done.\ncheers, Edda\n", [("person", "Edda")]), ("Ada Lark lives at 7 Old Mill Lane and", [("person", "Ada Lark"), ("address", "7 Old Mill Lane")]),
    ("signalの担当はAda Larkさんです。", [("person", "Ada Lark")]), ("Signed-off-by: A. Lark <ada@post.example>", [("person", "A. Lark"), ("email", "ada@post.example")]), ("Dear Dr. Ada Lark,", [("person", "Ada Lark")]),
]
NOTHING = [
    "The Tolvarin algorithm beats the Renée heuristic.", "Mail dev-list@matcher.example or security@x.example", "git@host.example:a/b.git is the remote", "The decorator @chunk.reconcile needs plugin@1.01.0", "Build 5450712191 passed", "Ticket 905-48-802 was merged", "See order 007471232-3257", "ISBN-like key 978-0-9120-5962-5",
    "timestamp 1355737629 falls", "Bound to 10.0.0.7:1732 and 192.0.2.98.", "uuid 7fda560e-1b9b-4ab5-9bbb-b2c266957828", "step 12 row Lane detection, depot Street view", "Hi team, could you", "Thanks to the new cache for it", "@ada_lark reacted", "2025-04-12 08:57:38 DEBUG x took 40ms", "Amount 1 282 606 016 bytes", "", "version 0.50.4828-rc6 is out", "Set email_format = \"user@domain\"",
]

INTRODUCED = {
    "My name is Anna Kowalski and I maintain it.": "Anna Kowalski", "Please ask Peter Müller about it": "Peter Müller", "Ich heiße Jonas Weber.": "Jonas Weber", "je m'appelle Claire Dubois": "Claire Dubois", "Me llamo Luis Ortega, y": "Luis Ortega",
    "Please ask Support about it": None, "My name is in the file": None, "please contact the maintainers for it": None, "Please ask on the list": None,
}


@pytest.mark.parametrize(("text", "want"), INTRODUCED.items())
def test_introduced(text, want):
    got = P.personal(text)
    assert [x.kind for x in got] == ["person"] * (want is not None) and all(text[x.start : x.end] == want for x in got)


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_found(text, want):
    got = P.personal(text)
    assert [x.kind for x in got] == [k for k, _ in want]
    assert all(text[x.start :].startswith(w) for x, (_, w) in zip(got, want, strict=True))


@pytest.mark.parametrize("text", NOTHING)
def test_nothing(text):
    assert P.personal(text) == []


def test_checks():
    assert P.luhn("4539578763621486") and not P.luhn("4539578763621487")
    assert P.confirmed("dni", "12345678Z") and not P.confirmed("dni", "12345678A") and P.confirmed("nie", "X1234567L")
    assert P.confirmed("nir", "1 84 12 76 451 089 46") == ((97 - 1841276451089 % 97) == 46)


def test_redaction_keeps_the_rest():
    text = "Hi Ayşe, write to ada@post.example or call +49 171 39200 26."
    assert P.redact(text, P.personal(text)) == "Hi [PERSON], write to [EMAIL] or call [PHONE]."
    assert P.redact("plain", []) == "plain"


def test_table(spark):
    rows = [(1, "ada@post.example", "x"), (1, "ada@post.example", "x"), (2, None, "y"), (3, "", "z"), (None, "ada@post.example", "q"), (4, "word " * 100_000 + "ada@post.example", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted((r.doc_id, r.start_at, r.kind) for r in P.find(df).distinct().collect()) == [(1, 0, "email"), (4, 500_000, "email")]
    out = {r.doc_id: r for r in P.redacted(df).collect()}
    assert out[2].text is None and out[3].text == "" and out[1].text == "[EMAIL]" and P.find(df.where("false")).count() == 0
