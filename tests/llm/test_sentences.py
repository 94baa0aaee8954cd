import random

import pytest

from leafwork.llm import sentences as S

NAMES = ["Tomas", "Verin", "Kalo", "Sedira", "Nimar", "Palo", "Rovin"]
NOUNS = ["garden", "river", "market", "letter", "harbour", "mirror", "teacher", "window", "lantern", "orchard"]
VERBS = ["saw", "kept", "found", "sold", "copied", "opened", "painted"]


def clause(r):
    return f"the {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)}"


def sentence(r):
    kind = r.randrange(6)
    body = clause(r)
    if kind == 0:
        return f"Dr. {r.choice(NAMES)} {r.choice(VERBS)} the {r.choice(NOUNS)}."
    if kind == 1:
        return f"“{body.capitalize()}!” said {r.choice(NAMES)}."
    if kind == 2:
        return f"{body.capitalize()}, e.g. {clause(r)}, at {r.randrange(90)}.{r.randrange(10)} m."
    if kind == 3:
        return f"{body.capitalize()}... and {clause(r)}{r.choice('.?!')}"
    if kind == 4:
        return f"{r.choice(NAMES)} wrote: “{body.capitalize()}.”"
    return body.capitalize() + r.choice([".", ".", "?", "!", "?!"])


def document(r, printed):
    """A text and its true units."""
    paras = [[sentence(r) for _ in range(r.randrange(1, 6))] for _ in range(r.randrange(2, 6))]
    if not printed:
        text, units = "", []
        for p in paras:
            for k, s in enumerate(p):
                text += " " * bool(k)
                units.append((len(text), len(text) + len(s)))
                text += s
            text += "\n"
        return text, "paragraphs", units
    text, units = "", []
    for p in paras:
        words = [(w, k) for k, s in enumerate(p) for w in s.split(" ")]
        width, spans = 0, {}
        for i, (w, k) in enumerate(words):
            if i:
                if width + 1 + len(w) > 50:
                    text += "\n"
                    width = 0
                else:
                    text += " "
                    width += 1
            a = len(text)
            text += w
            width += len(w)
            spans[k] = (spans.get(k, (a,))[0], len(text))
        units += spans.values()
        text += "\n\n"
    return text, "printed_lines", units


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    docs = [document(r, i % 2 == 0) for i in range(1500)]
    return S.train([x for t, k, _ in docs for x in S.examples(t, k)])


def test_held_out_accuracy(model):
    r = random.Random(2)
    found = right = true = 0
    for i in range(300):
        text, kind, units = document(r, i % 2 == 0)
        got = S.units(text, kind, model)
        found, true, right = found + len(got), true + len(units), right + len(set(got) & set(units))
    assert right / found > 0.97 and right / true > 0.97


def test_units_are_trimmed_and_in_order(model):
    text = "  Heading without stop \n\n\tThe river saw the letter.  Dr. Palo kept the mirror.\n"
    got = [text[a:b] for a, b in S.units(text, "paragraphs", model)]
    assert got == ["Heading without stop", "The river saw the letter.", "Dr. Palo kept the mirror."]


def test_thai_blanks():
    text = "คนเดินไป เขากลับมา 12 ครั้งแล้ว ดีๆ มาก"
    got = [text[a:b] for a, b in S.units(text, "paragraphs", S.Model({}))]
    assert got == ["คนเดินไป", "เขากลับมา 12 ครั้งแล้ว", "ดีๆ มาก"]


def test_leaders_and_decimals_are_no_ends(model):
    for text in ("Old garden .......... 12", "www.some.example/page.html", "3.75 and 1,000"):
        assert S.units(text, "paragraphs", model) == [(0, len(text))]


@pytest.mark.parametrize("text", ["", " ", "\n\n", "​ \n"])
def test_nothing(text, model):
    assert S.units(text, None, model) == []


def test_printed_lines_that_end_early_stand_alone():
    block = "short\nthis is a line as wide as the print goes here and\nnow it goes on"
    assert [block[a:b] for a, b in S.paragraphs(block, "printed_lines")] == ["short", "this is a line as wide as the print goes here and\nnow it goes on"]


def test_documents(spark, make_docs, model):
    r = random.Random(3)
    rows = [(i, *document(r, i % 2 == 0)[:2]) for i in range(40)] + [(100, None, None), (101, "", "paragraphs"), (102, "word " * 20_000, None)]
    docs = make_docs([(i, t, "s", k) for i, t, k in rows]).selectExpr("*", "1 AS start_pos")
    got = S.sentence_units(docs, model).collect()
    want = {(i, *u) for i, t, k in rows if t for u in S.units(t, k, model)}
    assert {tuple(x) for x in got} == want
    assert S.sentence_units(docs.limit(0), train_docs=10).count() == 0
    assert S.sentence_units(docs, train_docs=20).count() > 100


def test_same_units_however_the_documents_are_partitioned(spark, make_docs):
    import random

    from leafwork.llm.sentences import sentence_units

    r = random.Random(5)
    words = ["river", "Dr", "garden", "letter", "Mr", "old", "tower", "No", "7", "teacher"]
    text = lambda: " ".join(" ".join(r.choice(words) for _ in range(6)).capitalize() + r.choice([".", "!", "...", "?"]) for _ in range(8)).replace(". ", ".\n", 2)
    df = make_docs([(i, text(), "s", "paragraphs") for i in range(400)]).cache()
    got = [sorted(tuple(x) for x in sentence_units(df.repartition(n, c), train_docs=150).collect()) for n, c in ((1, "doc_id"), (5, "doc_id"), (7, "text"))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 400


def test_thai_is_told_at_each_blank():
    from leafwork.llm.sentences import Model, units

    thai = "ครูอ่านหนังสือ ชาวนาปลูกข้าว 25 ต้น เด็กเล่นบ่อยๆ แล้วกลับบ้าน"
    own = len(units(thai, "paragraphs", Model({})))
    assert own == 3
    latin = "word " * 120 + thai
    assert len(units(latin, "paragraphs", Model({}))) == own
