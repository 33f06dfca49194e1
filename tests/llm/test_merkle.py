"""Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import defaultdict


from storyspark.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, tree int"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbs(hashes):
    """(root, per leaf [(siblings, is the sibling before)])."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, p in enumerate(at):
            sib = p ^ 1
            paths[i].append((level[sib] if sib < len(level) else "", sib < p))
            at[i] = p // 2
        level = [digest("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def plain(rows):
    by_lang = defaultdict(list)
    for r in rows:
        r = r[:5]
        doc_id, source, lang, n_chars, text = r
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        changed = n_chars + 1 if hit and n_chars is not None else n_chars
        by_lang[lang].append((doc_id, leaf(*r), leaf(doc_id, source, lang, changed, text)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(climbs([x[1] for x in by_lang[lang]]))
    root, tops = climbs([t[0] for t in trees])
    out = []
    for lang, (sub, paths), top in zip(langs, trees, tops):
        for (doc_id, own, claim), path in zip(by_lang[lang], paths):
            h = claim
            for sib, before in path + top:
                h = digest(sib + h if before else h + sib)
            out.append((doc_id, own, sub, root, digest("".join(s for s, _ in path + top)), h, h == root))
    return sorted(out, key=repr)


def got(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, M.proofs(docs, M.tampered()).select(*cols).collect()), key=repr)


def test_proofs_equal_plain_trees(spark):
    rows = [(i * 3, f"s{i % 4}", "en" if i % 2 else "fr", i, f"text {i}", "h", 1) for i in range(11000)]   # beyond one block
    rows += [(i, "s", f"l{i}é", None if i % 3 else 5, "x", None, None) for i in range(40)]                 # more parts than a step spans
    rows += [(7, None, None, None, None, None, 2), (None, "s", None, 3, "", None, None), (None, "s", "en", 3, "y", None, None)]
    rows += [(5, "s", "de", 9, "same", "a", 3)] * 3 + [(5, "s", "de", 9, "other", "a", 3), (5, "", "", 0, "long " * 40000, None, None)]
    out = got(spark, rows)
    assert out == plain(rows)
    broken = [r for r in out if not r[6]]
    assert broken and all(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in broken)


def test_small_tables(spark):
    assert got(spark, []) == []
    for n in (1, 2, 3, 17):
        rows = [(i, "s", "en", 1, "t", None, None) for i in range(n)]
        assert got(spark, rows) == plain(rows)
    one = got(spark, [(1, "s", "en", 1, "t", None, None)])[0]
    assert one[1] == one[2] == one[3] == one[5]


def test_nodes_link_to_the_root(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", i, "t", None, None) for i in range(500)]
    nodes = {(r.tree, r.level, r.pos): r for r in M.manifest(M.leaves(spark.createDataFrame(rows, SCHEMA))).collect()}
    for r in nodes.values():
        steps = 0
        while r.up_tree is not None:
            above, steps = nodes[(r.up_tree, r.up_level, r.up_pos)], steps + 1
            h = r.hash.hex()
            for p in r.path:
                h = M._up(h, None if p.sib is None else p.sib.hex(), p.before)
            assert h == above.hash.hex()
            r = above
        assert r.tree == M.TOP and steps <= 12


def test_recursion_limits_are_put_back(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "123")
    try:
        got(spark, [(i, "s", "en", 1, "t", None, None) for i in range(300)])
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "123"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
