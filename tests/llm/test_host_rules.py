"""Quality rules against plain Python; host verdicts on planted hosts."""

import random
import re

from storyspark.llm import host_rules as HR

SCHEMA = "doc_id long, source string, text string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_features_match_brute_force(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "b", "cc", "é😀", "#%"]) + r.choice([" ", "\n", "\t ", "\x0b", "  ", "\n\n", "\xa0", "\x1c"])
                     for _ in range(r.randrange(120))) for _ in range(250)]
    texts += [None, "", " \n ", "a", "a a a a", "x y z " * 40, "same\nsame\n \n \nsame", "a b", "\n".join(f"w{i}" for i in range(900))]
    df = spark.createDataFrame([(i, f"s{i % 3}", t) for i, t in enumerate(texts)], SCHEMA)
    for x in HR.judge(df).collect():
        got = (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed)
        assert got == brute(texts[x.doc_id]), repr(texts[x.doc_id])
        assert not (x.base_failed and x.kept)


MARKS = "".join(f" #w{i}x" for i in range(15))


def prose(r):
    return " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(80))


def test_host_verdicts_and_clean_documents(spark):
    r = random.Random(4)
    rows = [(i, "good", prose(r)) for i in range(60)] + [(100, "good", prose(r) + MARKS)]
    rows += [(200 + i, "bad", prose(r) + MARKS) for i in range(60)] + [(300, "bad", prose(r))]
    rows += [(400, None, prose(r)), (401, None, None), (402, "tiny", prose(r) + MARKS), (402, "tiny", prose(r))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as kept", "2 as n_words")
    out = HR.kept_documents(df)
    kept = {x.doc_id for x in out.collect()}
    assert out.columns == df.columns
    assert set(range(60)) | {100, 300, 400} <= kept and not kept & ({401} | set(range(200, 260)))
    judged = HR.judge(df)
    assert sorted(x.doc_id for x in judged.where("kept").collect()) == sorted(x.doc_id for x in out.collect())
    assert judged.count() == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert HR.judge(df).collect() == [] and HR.kept_documents(df).collect() == []
