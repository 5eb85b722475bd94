"""DuckDB SQL for those queries that SQL can express."""

_SHA1_BASE32 = """
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (
      (((position(substr(hex || '00', 1 + 2 * ((5 * k) // 8), 1) in '0123456789abcdef') - 1) * 16 + position(substr(hex || '00', 2 + 2 * ((5 * k) // 8), 1) in '0123456789abcdef') - 1) * 256
      + greatest(0, (position(substr(hex || '00', 3 + 2 * ((5 * k) // 8), 1) in '0123456789abcdef') - 1) * 16 + position(substr(hex || '00', 4 + 2 * ((5 * k) // 8), 1) in '0123456789abcdef') - 1))
      // cast(power(2, 11 - (5 * k) % 8) as bigint)) % 32 as bigint), 1) for k in range(0, 32)], '')
"""


def _crc32(s: str) -> str:
    """CRC-32 of a string of ASCII, unsigned: each byte is an operation, and so is each of the eight steps after it (-1)."""
    steps = f"flatten(list_transform(range(1, length({s}) + 1), lambda i: [cast(ascii(substr({s}, i, 1)) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {steps}), lambda c, o: case when o >= 0 then xor(c, o) else xor(c >> 1, 3988292384 * (c & 1)) end))"


LEVELS = 7  #: levels of a tree in SQL: enough for 8**7 leaves


def _tree(name: str, leaves: str, group: str) -> str:
    """CTEs of a tree of width 8 over leaves (group, i, h, n, x): each leaf with the tree's top, its siblings and what x folds to."""
    out, before = [f"{name}0 as ({leaves})"], f"{name}0"
    for k in range(1, LEVELS + 1):
        out.append(f"{name}{k} as (select {group}, i // 8 as i, sha256(string_agg(h, '' order by i)) as h, (any_value(n) + 7) // 8 as n from {before} where n > 1 group by 1, 2)")
        before = f"{name}{k}"
    for k in range(LEVELS):
        side = lambda op: f"coalesce(string_agg(h, '' order by i) over (partition by {group}, i // 8 order by i rows between {op}), '')"
        out.append(f"{name}s{k} as (select {group}, i, {side('unbounded preceding and 1 preceding')} as lo, {side('1 following and unbounded following')} as hi from {name}{k} where n > 1)")
    out.append(f"{name}p0 as (select *, i as spot, '' as proof from {name}0)")
    for k in range(LEVELS):
        out.append(f"{name}p{k + 1} as (select p.* replace (p.spot // 8 as spot, case when s.i is null then p.x else sha256(s.lo || p.x || s.hi) end as x, p.proof || coalesce(s.lo || s.hi, '') as proof) from {name}p{k} p left join {name}s{k} s on p.{group} is not distinct from s.{group} and p.spot = s.i)")
    tops = " union all ".join(f"select {group}, h from {name}{k} where n = 1" for k in range(LEVELS + 1))
    out.append(f"{name}tops as ({tops})")
    return ",\n".join(out)


def _merkle() -> str:
    said = lambda text: " || ".join(f"coalesce(cast(strlen(cast({v} as varchar)) as varchar) || ':' || cast({v} as varchar), '-')" for v in ["doc_id", "source", "lang", "n_chars", text])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaves = f"""select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as i, count(*) over (partition by lang) as n from (
    select doc_id, lang, sha256({said('text')}) as h, case when {_crc32('cast(doc_id as varchar)')} % 3 = 0 then sha256({said(lower)}) else sha256({said('text')}) end as x from documents)"""
    over = "select 0 as one, lang, h, h as x, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from atops"
    last = ",\n".join(f"f{k + 1} as (select f.* replace (f.spot // 8 as spot, case when s.i is null then f.x else sha256(s.lo || f.x || s.hi) end as x) from f{k} f left join bs{k} s on f.spot = s.i)" for k in range(LEVELS))
    return f"""
with {_tree('a', leaves, 'lang')},
{_tree('b', over, 'one')},
f0 as (select p.doc_id, p.leaf, p.x, p.proof || t.proof as proof, t.leaf as subroot, t.i as spot from (select *, h as leaf from ap{LEVELS}) p join (select *, h as leaf from bp{LEVELS}) t on p.lang is not distinct from t.lang),
{last}
select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, x as folded_root, x = r.h as verified from f{LEVELS}, btops r
"""


#: Equal words q apart, in a row, are a stretch of period q; the shortest period of a stretch is its run's.
_RUNS = f"""
with d as (select row_number() over () as r, doc_id, cast({_crc32('cast(doc_id as varchar)')} as bigint) as h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
e as (select *, len(w) as n, h // 10 as g from d),
f as (select *, g % greatest(n, 1) as a from e),
t as (select r, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from f),
x as (select r, n, unnest(range(0, n)) as i, unnest(w) as word from t),
m as (select a.r, b.i - a.i as q, a.i, a.i - row_number() over (partition by a.r, b.i - a.i order by a.i) as island from x a join x b on a.r = b.r and a.word = b.word and b.i > a.i and (b.i - a.i) * 4 <= a.n),
l as (select r, q, min(i) as s, count(*) + q as l from m group by r, q, island having count(*) + q >= greatest(6, 4 * q)),
u as (select r, s, l, min(q) as q from l group by 1, 2, 3),
c as (select r, count(*) as n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q)) as runs_sha256 from u group by 1),
k as (select *, row_number() over (partition by r order by cast(l as double) / q desc, s, q) as place from u),
z as (select distinct r, unnest(range(s + q, s + l)) as i from u),
y as (select x.r, string_agg(word, ' ' order by x.i) as kept from x left join z on x.r = z.r and x.i = z.i where z.i is null group by 1)
select t.doc_id, coalesce(c.n_runs, 0) as n_runs, k.s as start, k.l as length, k.q as period, 1000 * k.l // k.q as exponent_milli,
  coalesce(c.runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(y.kept, '')) as collapsed_sha256
from t left join c on t.r = c.r left join k on t.r = k.r and k.place = 1 left join y on t.r = y.r
"""

_STEPS = 16  #: rounds in SQL: more than any two linked vectors of the test tables lie apart
_LINKS = (
    """
with v as materialized (select vec_id, label, cast(embedding as double[]) as e from embeddings),
ok as materialized (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
r0 as (select vec_id as node, vec_id as root from v),
"""
    + ",\n".join(f"r{k + 1} as materialized (select r.node, least(r.root, coalesce(min(s.root), r.root)) as root from r{k} r left join l on l.a = r.node left join r{k} s on s.node = l.b group by r.node, r.root)" for k in range(_STEPS))
    + f"""
select vec_id, coalesce(n, 0) as n_links, root as component_id, root = vec_id as kept from v join r{_STEPS} on node = vec_id left join (select a, count(*) as n from l group by 1) on a = vec_id
"""
)

ORACLE = {
    "op11_embedding_dedup": _LINKS,
    "op12_merkle_manifest": _merkle(),
    "op13_periodic_runs": _RUNS,
    "op3_warc": f"""
with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
q as (select *, min(page_id) over (partition by hex) as first_id from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes, {_SHA1_BASE32} as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to, url
from q
""",
}
