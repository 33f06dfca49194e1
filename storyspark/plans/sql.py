"""SQL builders for the DuckDB oracles (same rules, written independently as
set-based SQL: SimHash votes, canonical URLs, the unrolled K1 rounds)."""

from __future__ import annotations

URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PARAMS_RE = r"^(.*?)(?:;([^/]*))?$"


def signed64(x: str) -> str:
    return (f"CAST(CAST({x} AS HUGEINT) - CASE WHEN {x} >= CAST(9223372036854775808 AS UBIGINT) "
            f"THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END AS BIGINT)")


def simhash_ctes(name: str, src: str, id_col: str, text_col: str) -> str:
    """CTEs ending in ``name`` (id, sim_hi, sim_lo): normalize, 3-word
    shingles, MD5 halves, 128 signed votes, bit set when positive."""
    vh = ",\n  ".join(f"sum(CAST((h >> {b}) & CAST(1 AS UBIGINT) AS BIGINT) * 2 - 1) AS vh{b}"
                      for b in range(64))
    vl = ",\n  ".join(f"sum(CAST((l >> {b}) & CAST(1 AS UBIGINT) AS BIGINT) * 2 - 1) AS vl{b}"
                      for b in range(64))
    hu = " | ".join(f"(CASE WHEN vh{b} > 0 THEN CAST(1 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END << {b})"
                    for b in range(64))
    lu = " | ".join(f"(CASE WHEN vl{b} > 0 THEN CAST(1 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END << {b})"
                    for b in range(64))
    return f"""
{name}_n AS (SELECT {id_col} AS id, trim(regexp_replace(lower({text_col}), '\\s+', ' ', 'g')) AS norm FROM {src}),
{name}_w AS (SELECT id, CASE WHEN norm IS NULL OR norm = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(norm, ' ') END AS ws FROM {name}_n),
{name}_s AS (SELECT id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM {name}_w WHERE len(ws) > 0),
{name}_h AS (SELECT id, md5(array_to_string(ws[i:i+2], ' ')) AS m FROM {name}_s),
{name}_b AS (SELECT id, CAST('0x' || substr(m, 1, 16) AS UBIGINT) AS h, CAST('0x' || substr(m, 17, 16) AS UBIGINT) AS l FROM {name}_h),
{name}_v AS (SELECT id,
  {vh},
  {vl}
  FROM {name}_b GROUP BY id),
{name}_u AS (SELECT id, {hu} AS hu, {lu} AS lu FROM {name}_v),
{name} AS (SELECT w.id, coalesce({signed64('u.hu')}, 0) AS sim_hi, coalesce({signed64('u.lu')}, 0) AS sim_lo
           FROM {name}_w w LEFT JOIN {name}_u u ON u.id = w.id)"""


def hex128(hi: str, lo: str) -> str:
    return (f"CASE WHEN {hi} = 0 THEN lower(hex({lo})) "
            f"ELSE lower(hex({hi})) || lpad(lower(hex({lo})), 16, '0') END")


def unsigned64(x: str) -> str:
    return (f"CAST(CAST({x} AS HUGEINT) + CASE WHEN {x} < 0 THEN CAST(18446744073709551616 AS HUGEINT) "
            f"ELSE 0 END AS UBIGINT)")


def bit_range_sql(hi: str, lo: str, start: int, length: int) -> str:
    """Bits [start, start+length) of the 128-bit value (hi, lo) as UBIGINT."""
    end = min(start + length, 128)
    parts = []
    def mask(n):
        return "CAST(18446744073709551615 AS UBIGINT)" if n >= 64 else f"CAST({(1 << n) - 1} AS UBIGINT)"
    if start < 64:
        n = min(end, 64) - start
        parts.append(f"(({unsigned64(lo)} >> {start}) & {mask(n)})")
    if end > 64:
        s = max(start, 64) - 64
        n = end - 64 - s
        shift = max(0, 64 - start)
        parts.append(f"((({unsigned64(hi)} >> {s}) & {mask(n)}) << {shift})")
    return "(" + " | ".join(parts) + ")"


def reference_bands_sql(hi: str, lo: str) -> str:
    items = [f"lower(hex({bit_range_sql(hi, lo, 8 * i, 16)}))" for i in range(16)]
    return "concat_ws(',', " + ", ".join(items) + ")"


def canonical_url_ctes(name: str, src: str, id_col: str, url_col: str) -> str:
    """CTEs ending in ``name`` (id, url, canon, netloc)."""
    return f"""
{name}_p AS (SELECT {id_col} AS id, {url_col} AS url,
    regexp_extract({url_col}, '{URL_RE}', 1) AS scheme,
    regexp_extract({url_col}, '{URL_RE}', 2) AS netloc,
    regexp_extract({url_col}, '{URL_RE}', 3) AS pathfull,
    CASE WHEN regexp_matches({url_col}, '^[^#]*\\?') THEN regexp_extract({url_col}, '{URL_RE}', 4) ELSE '' END AS query,
    regexp_matches({url_col}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//') AS has_netloc
  FROM {src}),
{name}_q AS (SELECT *, regexp_extract(pathfull, '{PARAMS_RE}', 1) AS path0,
    regexp_extract(pathfull, '{PARAMS_RE}', 2) AS params FROM {name}_p),
{name} AS (SELECT id, url, netloc, query,
    (CASE WHEN scheme <> '' THEN lower(scheme) || ':' ELSE '' END)
    || (CASE WHEN has_netloc OR netloc <> '' THEN '//' || lower(netloc) ELSE '' END)
    || (CASE WHEN rtrim(path0, '/') = '' THEN '/' ELSE rtrim(path0, '/') END)
    || (CASE WHEN params <> '' THEN ';' || params ELSE '' END)
    || (CASE WHEN query <> '' THEN '?' || query ELSE '' END) AS canon,
    lower(scheme) AS lscheme, lower(netloc) AS lnetloc,
    (CASE WHEN rtrim(path0, '/') = '' THEN '/' ELSE rtrim(path0, '/') END) AS cpath, params
  FROM {name}_q)"""


def mis_ctes(name: str, nodes: str, edges: str, rounds: int = 12) -> str:
    """Unrolled K1 rounds. ``nodes`` (rid, a, can_keep); ``edges`` (s, r,
    kind, prio, dist, score) with s earlier than r. Ends in ``name`` (rid,
    kept, stage, duplicate_of, distance, score), naming over the final kept
    set: stage priority, lowest distance / highest score, latest, smallest id."""
    parts = [f"{name}_st0 AS MATERIALIZED (SELECT rid, CASE WHEN can_keep THEN 'U' ELSE 'D' END AS st FROM {nodes})"]
    for k in range(1, rounds + 1):
        p = f"{name}_st{k - 1}"
        parts.append(f"""{name}_st{k} AS MATERIALIZED (
  SELECT n.rid, CASE WHEN p.st <> 'U' THEN p.st WHEN coalesce(x.hk, false) THEN 'D'
                     WHEN coalesce(x.hu, false) THEN 'U' ELSE 'K' END AS st
  FROM {nodes} n JOIN {p} p ON p.rid = n.rid
  LEFT JOIN (SELECT e.r AS rid, bool_or(q.st = 'K') AS hk, bool_or(q.st = 'U') AS hu
             FROM {edges} e JOIN {p} q ON q.rid = e.s GROUP BY e.r) x ON x.rid = n.rid)""")
    last = f"{name}_st{rounds}"
    parts.append(f"""{name}_nm AS (
  SELECT e.r AS rid, e.s, e.kind, e.dist, e.score,
         row_number() OVER (PARTITION BY e.r ORDER BY e.prio, e.dist NULLS LAST, e.score DESC NULLS LAST,
                                                     sn.a DESC, e.s) AS rn
  FROM {edges} e JOIN {last} k ON k.rid = e.s AND k.st = 'K'
  JOIN {nodes} sn ON sn.rid = e.s
  JOIN {last} d ON d.rid = e.r AND d.st = 'D')""")
    parts.append(f"""{name} AS (
  SELECT f.rid, CASE f.st WHEN 'K' THEN true WHEN 'D' THEN false END AS kept,
         CASE WHEN f.st = 'D' THEN coalesce(m.kind, 'no_vector') END AS stage,
         m.s AS duplicate_of,
         CASE WHEN m.kind = 'simhash' THEN CAST(m.dist AS INTEGER) END AS distance,
         CASE WHEN m.kind = 'vector' THEN round(m.score, 6) END AS score
  FROM {last} f LEFT JOIN (SELECT * FROM {name}_nm WHERE rn = 1) m ON m.rid = f.rid)""")
    return ",\n".join(parts)
