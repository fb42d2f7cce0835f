import random
import re
import textwrap

from corelens.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def naive(text):
    words = WORD.findall(_fold(text))
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        if at:
            base.add(label)
    lines = [WORD.findall(line) for line in _fold(text).split("\n")]
    for label, texts in ls.TEMPLATES.items():
        for t in texts:
            own = set(WORD.findall(_fold(t)))
            width = len(WORD.findall(_fold(t))) * 5 // 4
            for block in lines + [words[i : i + width] for i in range(len(words)) if words[i] in own]:
                c = len(own & set(block)) / len(own)
                if c >= 0.8:
                    labels.add(label)
                    score = max(score, c)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score


def _texts():
    rng = random.Random(2)
    out = [None, "", "CC BY", "cc-by cc by\ncc\nby", "ÀCC BY all rights\nreserved ALL RIGHTS RESERVED!", "General Public License general public\tlicense", "ccby 4.0", "\x00cc\x7fby"]
    for texts in ls.TEMPLATES.values():
        for t in texts:
            words = t.split()
            for drop in (0, 1, 2, len(words) // 5, len(words) // 4, len(words) // 3):
                kept = words.copy()
                for _ in range(min(drop, len(kept) - 1)):
                    kept.pop(rng.randrange(len(kept)))
                rng.shuffle(kept) if rng.random() < 0.3 else None
                out.append("prose before\n" + " ".join(rng.choices(["ou", "éa", "the"], k=8) + kept) + "\nafter")
            half = len(words) // 2
            out.append(" ".join(words[:half]) + "\n" + " ".join(words[half:]))
            out.append("int x;\n * " + textwrap.fill(t, 40).replace("\n", "\n * ") + "\n */")
            out.append("\n\n".join(words[:half]) + " filler" * 30 + " ".join(words[half:]))
    out.append("word " * 30_000 + "all rights reserved")
    return out


def test_matches_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    rows = {r.doc_id: tuple(r)[1:] for r in ls.license_scan(df.repartition(3)).collect()}
    assert rows == {k: naive(t) for k, t in enumerate(texts)}


def test_join_is_exact_for_any_threshold():
    rng = random.Random(4)
    vocabulary = [f"w{i}".encode() for i in range(30)]
    templates = {f"t{k}": [" ".join(w.decode() for w in rng.sample(vocabulary, rng.randint(1, 12)))] for k in range(25)} | {"none": ["..."]}
    for threshold in (0.3, 0.5, 0.8, 1.0):
        index = ls.ContainmentIndex(templates, {w: rng.randint(0, 50) for w in vocabulary}, threshold)
        for _ in range(200):
            block = frozenset(rng.sample(vocabulary, rng.randint(0, 25)))
            want = sorted((label, len(s & block) / len(s)) for label, s in ((k, frozenset(v[0].encode().split())) for k, v in templates.items() if k != "none") if len(s & block) >= threshold * len(s) - 1e-9)
            assert sorted(index.matches(block)) == want


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, "x")], "doc_id long, text string")
    assert ls.license_scan(df.limit(0)).collect() == []
    rows = ls.license_scan(df).collect()
    assert len(rows) == 3 and sum(r.n_base for r in rows) == 2


def test_wrapped_notices_are_found(spark):
    texts = [(k, "# " + textwrap.fill(t, 72).replace("\n", "\n# ")) for k, ts in enumerate(ls.TEMPLATES.values()) for t in ts[-1:]]
    found = {r.doc_id: r.labels.split(",") for r in ls.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, label in enumerate(ls.TEMPLATES):
        assert label in found[k]


def test_sql_agrees(spark):
    import duckdb
    import pyarrow as pa

    texts = _texts()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    want = sorted(con.sql(ls.oracle()).fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in ls.license_scan(df).collect()) == want
