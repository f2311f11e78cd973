"""SQL that gives the rows of the queries, where SQL can express them."""

SQL: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _level(name: str, parent: str, above: list[str], level: str, weight: str) -> str:
    """One level of the budget tree: ``name`` holds the given tokens of each child of ``parent``."""
    keys = ", ".join(above)
    part = f"PARTITION BY {keys}" if above else ""
    join = f"JOIN {parent} USING ({keys})" if above else f"CROSS JOIN {parent}"
    pre = keys + ", " if above else ""
    order = f"OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    nth = f"row_number() OVER (PARTITION BY {pre}is_full ORDER BY cap / w, {level})"
    return f"""
{name}_n AS (SELECT {pre}{level}, sum(cap)::BIGINT AS cap, any_value({weight})::BIGINT AS w FROM leaves GROUP BY ALL),
{name}_a AS (SELECT {name}_n.*, given AS budget, given - coalesce(sum(cap) {order}, 0) AS lft, sum(w) OVER ({part}) - coalesce(sum(w) {order}, 0) AS wts
  FROM {name}_n {join} WHERE cap > 0 AND w > 0),
{name}_b AS (SELECT *, cap * wts <= lft * w AS is_full FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0) AS rest, sum(w) FILTER (NOT is_full) OVER ({part}) AS opn FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN is_full THEN cap ELSE rest * w // opn END AS got FROM {name}_c),
{name}_e AS (SELECT *, budget - sum(got) OVER ({part}) AS spare, {nth} AS nth FROM {name}_d),
{name} AS (SELECT {pre}{level}, (got + CASE WHEN NOT is_full AND nth <= spare THEN 1 ELSE 0 END)::BIGINT AS given FROM {name}_e)"""


_PLACE = "md5('11:' || (given // tokens + 1)::BIGINT || ':' || coalesce(doc_id::VARCHAR, '') || ':' || n_tokens)"

SQL["op1_mix_sources"] = rf"""
WITH d AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
rows_ AS (SELECT *, CASE WHEN n_tokens >= 300 THEN 'long' ELSE 'short' END AS domain, coalesce(lang, '') AS l, coalesce(source, '') AS s FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, l, s, sum(n_tokens)::BIGINT AS tokens, 4 * sum(n_tokens)::BIGINT AS cap FROM rows_ GROUP BY ALL),
top AS (SELECT (sum(tokens) * 50 // 100)::BIGINT AS given FROM leaves),
{_level('l1', 'top', [], 'domain', "CASE domain WHEN 'long' THEN 3 WHEN 'short' THEN 2 ELSE 1 END")},
{_level('l2', 'l1', ['domain'], 'l', "CASE l WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END")},
{_level('l3', 'l2', ['domain', 'l'], 's', "1")},
placed AS (SELECT rows_.*, given // tokens AS whole, given % tokens AS rest, {_PLACE} AS place FROM rows_ JOIN leaves USING (domain, l, s) JOIN l3 USING (domain, l, s)),
summed AS (SELECT domain, l, s, place, sum(n_tokens) AS n, count(*) AS m FROM placed GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY domain, l, s ORDER BY place) - n AS before FROM summed),
cut AS (SELECT p.*, CASE WHEN rest <= before THEN 0 WHEN rest >= before + n THEN n_tokens ELSE least(n_tokens, (rest - before) // m) END AS last
  FROM placed p JOIN upto USING (domain, l, s, place)),
epochs AS (SELECT *, unnest(range(1, (whole + CASE WHEN last > 0 THEN 1 ELSE 0 END)::BIGINT + 1)) AS epoch FROM cut)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens, (CASE WHEN epoch <= whole THEN n_tokens ELSE last END)::BIGINT AS taken_tokens FROM epochs
"""

_RULES = [("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block")]
_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"


def _case(rules: list[tuple[str, str]], pick: int) -> str:
    whens = []
    for r in rules:
        h, _, p = r[0].partition("/")
        whens.append(f"WHEN {_FITS.format(h=h, p=p)} THEN '{r[pick]}'")
    return f"CASE {' '.join(whens)} END"


_SHAPES = ("none", "digits", "page", "word", "mixed")


def _shape(c: str) -> str:
    return (f"CASE WHEN {c} = '' THEN 'none' WHEN regexp_matches({c}, '^([0-9]+|\\*)/?$') THEN 'digits' WHEN regexp_matches({c}, '^([0-9]+|\\*)\\.([a-z]+|\\*)$') THEN "
            f"CASE WHEN {c} = '*.*' THEN 'mixed' ELSE 'page' END WHEN regexp_matches({c}, '^[A-Za-z_-]+/?$') THEN 'word' ELSE 'mixed' END")


def _wild(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[0-9]+/?$') THEN '*' WHEN regexp_matches({c}, '^[0-9]+\\.[a-z]+$') THEN '*.*' ELSE {c} END"


_LEVELS = 8


def _templates(i: int) -> str:
    above = ", ".join(["host", *[f"t{k}" for k in range(1, i)]])
    below = f"k{i + 1}"
    stats = [f"f_{s}" for s in _SHAPES]
    features = ", ".join(f"coalesce(sum(n) FILTER ({below} = '{s}'), 0) AS f_{s}" for s in _SHAPES)
    firsts = ", ".join(f"first_value({x}) OVER w AS lead_{x}" for x in ["n", *stats])
    far = "greatest(" + ", ".join(f"abs({x} / n - lead_{x} / lead_n)" for x in stats) + ")"
    bound = "sqrt(0.5 * ln(2 / 0.05)) * (1 / sqrt(n) + 1 / sqrt(lead_n))"
    most = ", ".join(f"CASE WHEN f_{s} = greatest({', '.join(stats)}) THEN '{s}' END" for s in _SHAPES)
    prev = f"c{i - 1}"
    return f"""
b{i} AS MATERIALIZED (SELECT {above}, s{i}, sum(n) AS n, {features} FROM {prev} GROUP BY ALL),
a{i} AS (SELECT *, coalesce({most}) AS alike FROM b{i}),
g{i} AS (SELECT *, count(*) OVER (PARTITION BY {above}) AS kinds, sum(n) OVER (PARTITION BY {above}) AS every, first_value(s{i}) OVER w AS lead, {firsts}
  FROM a{i} WINDOW w AS (PARTITION BY {above}, alike ORDER BY n DESC, s{i} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m{i} AS (SELECT {above}, s{i}, CASE WHEN kinds >= 16 AND kinds >= 0.5 * every THEN '*' WHEN n >= 8 AND {far} < {bound} THEN lead ELSE s{i} END AS t{i} FROM g{i}),
c{i} AS MATERIALIZED (SELECT * FROM {prev} JOIN m{i} USING ({above}, s{i}))"""


_SEGMENTS = ", ".join(f"s{i}" for i in range(1, _LEVELS + 1))
_TEMPLATE = ", ".join(f"t{i}" for i in range(1, _LEVELS + 1))

# A template is rejected if nearly all of its URLs that a rule speaks of are blocked; it speaks for those without a rule.
SQL["op2_url_filter"] = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {_case(_RULES, 0)} AS rule, {_case(_RULES, 1)} AS said, string_split(path, '/') AS seg FROM p),
s AS (SELECT *, {", ".join(f"coalesce(seg[{i + 1}], '') AS p{i}" for i in range(1, _LEVELS))}, coalesce(array_to_string(seg[{_LEVELS + 1}:], '/'), '') AS p{_LEVELS} FROM r),
t AS MATERIALIZED (SELECT page_id, host, path, rule, said, {", ".join(f"{_wild(f'p{i}')} AS s{i}" for i in range(1, _LEVELS + 1))} FROM s),
c0 AS MATERIALIZED (SELECT host, {_SEGMENTS}, count(*) AS n, count(said) AS ruled, count(*) FILTER (said = 'block') AS blocked,
  {", ".join(f"{_shape(f's{i}')} AS k{i}" for i in range(2, _LEVELS + 1))}, 'none' AS k{_LEVELS + 1} FROM t GROUP BY ALL),
{",".join(_templates(i) for i in range(1, _LEVELS + 1))},
j AS (SELECT host, {_TEMPLATE}, (sum(blocked) + 5 * 0.1::DOUBLE) / (sum(ruled) + 5.0::DOUBLE) AS purity FROM c{_LEVELS} GROUP BY ALL HAVING purity >= 0.8),
x AS (SELECT host, {_SEGMENTS}, rtrim(concat_ws('/', host, {_TEMPLATE}), '/') AS template, purity FROM c{_LEVELS} JOIN j USING (host, {_TEMPLATE}))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM t LEFT JOIN x USING (host, {_SEGMENTS})
"""

SQL["op4_warc_archive"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

SQL["op8_nearest_neighbours"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(q.v, e.v) AS score FROM e AS q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

SQL["op10_near_duplicates"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM reach AS r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
