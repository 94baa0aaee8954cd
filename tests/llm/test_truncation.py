import random

from leafwork.llm.truncation import truncated, truncation_by_source

NOUNS = ["garden", "river", "market", "letter", "harbour", "mirror", "teacher", "window", "lantern", "orchard", "carpenter", "instrument"]
VERBS = ["remembered", "painted", "followed", "abandoned", "measured"]


def sentence(r):
    return f"The {r.choice(['old', 'tall', 'quiet', 'northern'])} {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} {r.choice(['beside', 'under', 'behind'])} the {r.choice(NOUNS)} yesterday."


def texts(r, n):
    return [" ".join(sentence(r) for _ in range(r.randrange(3, 8))) for _ in range(n)]


def run(make_docs, docs):
    return {r.doc_id for r in truncated(make_docs(docs)).collect()}


def test_cuts_of_many_kinds(make_docs):
    r = random.Random(1)
    docs = [(i, t, "whole", "paragraphs") for i, t in enumerate(texts(r, 400))]
    full = texts(r, 40)
    lacking = [(1000 + i, t[:-1], "plain", "paragraphs") for i, t in enumerate(full[:10])]
    in_word = [(2000 + i, t[: t.rindex("yesterday") + 5], "plain", "paragraphs") for i, t in enumerate(full[10:20])]
    in_sentence = [(3000 + i, t[: t.rindex(" the ") + 4], "plain", "paragraphs") for i, t in enumerate(full[20:30])]
    marked = [(4000 + i, t[: t.rindex(" the ")] + m, "plain", "paragraphs") for (i, t), m in zip(enumerate(full[30:40]), ["…", "...", " [...]", " […]", "�"] * 2)]
    got = run(make_docs, docs + lacking + in_word + in_sentence + marked + [(5000, None, "plain", None), (5001, "", "plain", None), (5002, " \n ", None, None)])
    assert got == {d[0] for d in in_word + in_sentence + marked}


def test_site_lines_after_the_cut(make_docs):
    r = random.Random(2)
    note = "\nRead the complete edition at our reading site"
    docs = [(i, t + note, "site", "paragraphs") for i, t in enumerate(texts(r, 300))]
    cut = [(1000 + i, t[: t.rindex(" the ") + 4] + note, "site", "paragraphs") for i, t in enumerate(texts(r, 10))]
    assert run(make_docs, docs + cut) == {d[0] for d in cut}


def test_limit_of_a_source(make_docs):
    r = random.Random(3)
    docs = [(i, t, "free", "paragraphs") for i, t in enumerate(texts(r, 200))]
    long = [(1000 + i, " ".join(sentence(r) for _ in range(12))[:300], "limited", "paragraphs") for i in range(30)]
    ended = {d[0] for d in long if d[1].endswith(".")}
    assert run(make_docs, docs + long) == {d[0] for d in long} - ended


def test_long_site_lines_in_any_form_after_the_cut(make_docs):
    r = random.Random(6)
    note = "\nThis text is offered by the friends of our reading site, who ask every reader to tell others of the complete edition, to write to the keepers of the collection about faults, and to leave this notice where it stands" * 3
    docs = [(i, t + (note if i % 2 else note.replace("e", "е").upper()), "site", "paragraphs") for i, t in enumerate(texts(r, 300))]
    cut = [(1000 + i, t[: t.rindex(" the ") + 4] + note, "site", "paragraphs") for i, t in enumerate(texts(r, 10))]
    blank = [(2000 + i, t[: t.rindex(" the ") + 4] + " " * 200, "site", "paragraphs") for i, t in enumerate(texts(r, 5))]
    assert run(make_docs, docs + cut + blank) == {d[0] for d in cut + blank}


def test_limits_of_sources_that_cut_back_or_count_bytes(make_docs):
    r = random.Random(5)
    words = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 5))) for _ in range(3000)]
    prose = lambda n: " ".join(" ".join(r.choice(words) for _ in range(8)).capitalize() + "." for _ in range(n))
    whole = [(i, prose(r.randrange(1, 12)), s, "paragraphs") for i, s in enumerate(["back", "bytes", "free"] * 60)]
    whole = [(i, t if s != "back" else t[: t.rindex(".", 0, 300) + 1] if len(t) > 300 else t, s, k) for i, t, s, k in whole]
    back = [(1000 + i, (t := prose(12)[:300])[: t.rindex(" ")].rstrip(".") + m, "back", "paragraphs") for i, m in enumerate(["…", "..."] * 15)]
    octets = [(2000 + i, prose(14).replace("a", "é").encode()[:400].decode(errors="ignore"), "bytes", "paragraphs") for i in range(30)]
    whole = [x for x in whole if x[2] != "bytes" or len(x[1]) < 380]
    ended = {d[0] for d in octets if d[1].rstrip().endswith(".")}
    got = run(make_docs, whole + back + octets)
    assert {d[0] for d in back + octets} - ended <= got
    assert len(got & {d[0] for d in whole}) <= 2


def test_report(make_docs):
    r = random.Random(4)
    docs = [(i, t, "a" if i % 2 else None, "paragraphs") for i, t in enumerate(texts(r, 200))] + [(900, "The old garden remembered the", "a", "paragraphs"), (901, None, "b", None)]
    got = {x.source: (x.docs, x.cut_docs) for x in truncation_by_source(make_docs(docs)).collect()}
    assert got == {"a": (101, 1), None: (100, 0), "b": (1, 0)}
    assert truncation_by_source(make_docs(docs).limit(0)).count() == 0


def test_counts_beyond_the_broadcast_are_the_same(make_docs, monkeypatch):
    from leafwork.llm import truncation

    r = random.Random(8)
    docs = [(i, t, "whole", "paragraphs") for i, t in enumerate(texts(r, 200))] + [(1000 + i, t[: t.rindex(" the ") + 4], "plain", "paragraphs") for i, t in enumerate(texts(r, 10))]
    df = make_docs(docs)
    want = sorted(tuple(x) for x in truncation.ends(df).select("doc_id", "decided_by").collect())
    monkeypatch.setattr(truncation, "BROADCAST_ROWS", 0)
    assert sorted(tuple(x) for x in truncation.ends(df).select("doc_id", "decided_by").collect()) == want
    assert {d for d, by in want if by} == set(range(1000, 1010))


def test_many_site_lines_after_the_cut(make_docs):
    r = random.Random(9)
    notes = "".join(f"\n\n{k} notice of the reading site number {'abcdefghijkl'[k] * 3} for its readers" for k in range(12))
    docs = [(i, t + notes, "site", "printed_lines") for i, t in enumerate(texts(r, 150))] + [(1000 + i, t[: t.rindex(" the ") + 4] + notes, "site", "printed_lines") for i, t in enumerate(texts(r, 6))]
    docs += [(2000, notes, "site", "printed_lines"), (2001, "short", "site", None)]
    assert run(make_docs, docs) == set(range(1000, 1006))
