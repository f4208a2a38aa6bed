import base64
import quopri
import random

import pytest

from seqloom.llm import mail, subjects

HEAD = "From: A <a@x.example>\nSubject: court and law\n"


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "From: a\n\n", HEAD])
def test_nothing(text):
    assert not text or mail.own_sentences(text) == []


def test_decoding():
    body = "Größe über alles. Das zweite."
    q = quopri.encodestring(body.encode()).decode()
    b = base64.b64encode(body.encode()).decode()
    for coding, text in (("8bit", body), ("quoted-printable", q), ("base64", b)):
        got = mail.own_sentences(f"{HEAD}Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: {coding}\n\n{text}")
        assert got == ["Größe über alles.", "Das zweite."]
    assert mail.own_sentences(f"{HEAD}\n{body.encode().decode('cp1252')}") == ["Größe über alles.", "Das zweite."]


def test_parts():
    text = f"""{HEAD}Content-Type: multipart/alternative;
 boundary="zz"

--zz
Content-Type: text/plain

Plain one. Plain two.
--zz
Content-Type: text/html

<html><body><p>Plain one. Plain two.</p></body></html>
--zz
Content-Type: application/pdf; name="x.pdf"
Content-Disposition: attachment

Not this. Nor this.
--zz--
"""
    assert mail.own_sentences(text) == ["Plain one.", "Plain two."]
    only = "Content-Type: text/html\n\n<p>One &amp; two.</p><blockquote>Old text.</blockquote>"
    assert mail.own_sentences(HEAD + only) == ["One & two."]


@pytest.mark.parametrize(
    "rest",
    [
        "\n\n> Old one. Old two.",
        "\n\nOn Thu, 15 Sep 2016, A wrote:\n> Old one.\n> Old two.",
        "\n\n-----Original Message-----\nFrom: A\n\nOld one. Old two.",
        "\n\n________________________________\nFrom: A\n\nOld one.",
        "\n\nA <a@x.example> wrote on Fri, 1 Jan 2021:\nOld one. Old two.",
        "\n\nBest,\nA. Person\nOld Street one.",
        "\n\n--\nA\n\nCONFIDENTIAL - no contract arises from this mail.",
        "\n\nPlease think of the trees before you print this mail.",
    ],
)
def test_what_is_not_own(rest):
    assert mail.own_sentences(f"{HEAD}\nHi B,\n\nNew one. New\ntwo.{rest}") == ["New one.", "New two."]


def test_answer_below():
    quoted = "On Thu, 15 Sep 2016, A wrote:\nHi B,\n\nOld one.\n\nBest,\nA\n\nCONFIDENTIAL - old.\n\n"
    assert mail.own_sentences(f"{HEAD}\n{quoted}New one. New two.\n\nCheers,\nB") == ["New one.", "New two."]
    marked = "> Old one.\n\n"
    assert mail.own_sentences(f"{HEAD}\n{marked}New one.") == ["New one."]


def invented(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(n)]


WORDS = {c: invented(k, 25) for k, c in enumerate(("law", "music", "sport", "food"))}
FILL = [" ".join(invented(100 + k, 4)).capitalize() + "." for k in range(12)]


def made(n, seed):
    r = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        own = []
        for code in WORDS:
            k = r.choice([0, 0, 0, 1, 2, 3])
            if k >= 2:
                truth.add((i, code))
            own += [f"The {r.choice(WORDS[code])} and the {r.choice(WORDS[code])} came." for _ in range(k)]
        own += r.sample(FILL, r.randint(0, 2))
        r.shuffle(own)
        rows.append((i, HEAD + "\n" + " ".join(own) + "\n\n> " + f"The {r.choice(WORDS['law'])} came. The {r.choice(WORDS['law'])} came.", "x"))
    return rows, truth


def test_subjects(spark):
    rows, truth = made(1500, 1)
    rows += [(9001, None, "x"), (9002, "", "x"), (9003, HEAD, "x"), (9004, HEAD + "\n" + f"The {WORDS['law'][0]} and the {WORDS['law'][1]} came. " * 4000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, terms string").repartition(6)
    areas = spark.createDataFrame([(c, c, "") for c in (*WORDS, "void")], "subject_code string, title string, description string")
    r = random.Random(2)
    # no example has the last five words of a subject; they are learnt from the mails
    sentence = lambda c: f"The {r.choice(WORDS[c][:20])} and the {r.choice(WORDS[c][:20])} came."
    examples = [(k, c, "en", f"{sentence(c)} {sentence(c)} {r.choice(FILL)}") for k, c in enumerate([*WORDS] * 25)]
    made_of = spark.createDataFrame(examples, "example_id bigint, subject_code string, lang string, example_text string")
    got = {(x.doc_id, x.subject_code) for x in subjects.subjects_of(docs, areas, made_of).collect()}
    assert (9004, "law") in got
    got -= {(9004, "law")}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)
    assert subjects.subjects_of(docs.limit(0), areas, made_of).count() == 0
