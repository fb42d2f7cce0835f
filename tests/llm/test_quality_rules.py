import random
import re

from pyspark.sql import functions as F

from corelens.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def naive(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def _texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x x x x x", "l1\nl1\n\n \nl1 \nl1", "😀 é # * \x0b tab\x0c end", "a b c d"]
    for _ in range(40):
        words = rng.choices(["the", "of", "und", "ab", "cd", "e#f", "|", "great", "é"], k=rng.randint(0, 120))
        out.append(re.sub(" ", lambda m: rng.choice([" ", " ", "\n", "  ", "\t"]), " ".join(words)))
    out.append(" ".join(f"w{i % 700}" for i in range(3000)))
    return out


def test_measures(spark):
    texts = _texts()
    df = spark.createDataFrame([(k, t, 3) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = {r.doc_id: r for r in q.quality_rules(df).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == naive(t), t
        assert not (r.kept and r.base_failed)


def test_windows_whose_hashes_clash(spark):
    texts = [t for t in _texts() if t]
    words = F.split(F.btrim("text", F.lit(q.SPACE)), "[\\x20\\x09-\\x0D]+")
    df = spark.createDataFrame([(t,) for t in texts if WORD.search(t)], "text string")
    for hashed in (lambda *w: F.lit(7), lambda *w: F.length(w[0])):
        for r in df.select("text", q._let(words, lambda w: q._repeat_words(w, hashed)).alias("n")).collect():
            assert r.n == naive(r.text)[4], r.text


def test_rules_are_one_projection(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = q.quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Exchange|Arrow", plan)


def test_verdicts(spark):
    good = " ".join(f"the word{i} of thing{i}" for i in range(40))
    cases = {"good": good, "symbols": good.replace("of", "#$#"), "stop": " ".join(f"word{i}" for i in range(80)), "short": "the of and", "lines": "\n".join(["the same line of text here now ok"] * 20 + [good])}
    df = spark.createDataFrame(list(enumerate(cases.values())), "doc_id long, text string")
    kept = {name: r.kept for name, r in zip(cases, sorted(q.quality_rules(df).collect()))}
    assert kept == {"good": True, "symbols": False, "stop": False, "short": False, "lines": False}
    strict = (q.Rule("many", "n_words", "one", 1_000_000, None),)
    assert not any(r.kept for r in q.quality_rules(df, strict).collect())
    assert q.quality_rules(df.limit(0)).collect() == []
    assert q.quality_rules(df.withColumn("text", F.lit(None).cast("string"))).where("kept").count() == 0
