"""DuckDB SQL for the operators that SQL can express, made from the same rules and parameters."""

from __future__ import annotations

from lexiloom.llm import decontamination, jaccard, licences, ranking, secrets, sharding, words

_SPACE = r"[\x20\x09-\x0D]+"


def _crc_table() -> str:
    """The 256 steps of crc32, by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return f"[{','.join(out)}]::BIGINT[]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sharding_sql() -> str:
    def draw(path: str, weight: float) -> str:
        return f"-ln((('0x' || substr(md5(key || {_quoted(path)}), 1, 12))::BIGINT + 0.5) / {1 << 48}.0) / {weight!r}"

    def shard(node: dict | float, path: str, name: object = None) -> str:
        if not isinstance(node, dict):
            return str(name)
        if len(node) == 1:
            n, child = next(iter(node.items()))
            return shard(child, f"{path}/{n}", n)
        least = "least(" + ", ".join(draw(f"{path}/{n}", sharding._weight(c)) for n, c in node.items()) + ")"
        arms = " ".join(f"WHEN {draw(f'{path}/{n}', sharding._weight(c))} = {least} THEN {shard(c, f'{path}/{n}', n)}" for n, c in node.items())
        return f"CASE {arms} END"

    n = sharding.BASE_SHARDS
    return f"""WITH t AS (SELECT {_crc_table()} AS tbl), d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, encode(coalesce(text, '')) AS raw FROM documents),
b AS (SELECT doc_id, key, octet_length(raw) + 1 AS size, list_transform(regexp_extract_all(hex(raw), '..'), lambda p: ('0x' || p)::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, key, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, tbl[1 + xor(c & 255, v)])), 4294967295) AS text_crc32 FROM b, t),
s AS (SELECT *, ({shard(sharding.laid_out(n), '')})::INT AS shard, ({shard(sharding.laid_out(n + 1), '')})::INT AS grown_shard, ('0x' || substr(md5(key || '/' || size || '/' || text_crc32), 1, 12))::BIGINT % (SELECT greatest(1, ceil(count(*) / {sharding.PART_ROWS * n}.0))::BIGINT FROM documents) AS part FROM c)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s"""


def secrets_sql() -> str:
    found = []
    for n, r in enumerate(secrets.RULES):
        pattern = _quoted(r.pattern)
        # matches are marked in the text, and their places follow from the lengths of what lies between the marks
        marked = f"string_split(regexp_replace(text, {pattern}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"
        found.append(
            f"SELECT doc_id, {n} AS rule, {_quoted(r.kind)} AS kind, length(regexp_extract(m, {pattern}, {r.group})) AS held, before AS start, before + length(m) AS stop FROM "
            f"(SELECT doc_id, string_split(part, chr(2))[1] AS m, i, sum(CASE WHEN i = 1 THEN length(part) ELSE length(part) - 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before "
            f"FROM (SELECT doc_id, unnest({marked}) AS part, generate_subscripts({marked}, 1) AS i FROM documents WHERE text IS NOT NULL)) WHERE i > 1 AND length(regexp_extract(m, {pattern}, {r.group})) >= {r.least}"
        )
    base = len(secrets.BASE)
    span = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (rule = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return f"""WITH f AS ({' UNION ALL '.join(found)}),
g AS (SELECT doc_id, {counts}, coalesce(string_agg({span}, ',' ORDER BY start, rule) FILTER (rule < {base}), '') AS base, string_agg({span}, ',' ORDER BY start, rule) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


def jaccard_sql() -> str:
    rule = jaccard.QUERY
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{jaccard._UPPER}', '{jaccard._LOWER}'), '{_SPACE}'), lambda w: w <> '')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {rule.words} THEN list_distinct(list_transform(range(1, len(w) - {rule.words - 2}), lambda i: array_to_string(w[i:i + {rule.words - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common * {rule.den} >= {rule.num} * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""


def licences_sql() -> str:
    model, confirm, least = licences.trained(), licences.CONFIRM, licences.LEAST
    weights = ", ".join(f"({_quoted(f)}, {k}, {round(w, 6)!r}::DOUBLE)" for f, ws in model.weights.items() for k, w in enumerate(ws))
    names = ", ".join(f"({k}, {_quoted(f)}, {round(b, 6)!r}::DOUBLE)" for k, (f, b) in enumerate(zip(model.families, model.bias, strict=True)))
    pairs = ", ".join(f"({_quoted(f)}, {i}, {_quoted(p)}, {len(licences.pairs_of(t))})" for f, ts in licences.TEMPLATES.items() for i, t in enumerate(ts) for p in sorted(licences.pairs_of(t)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH wt(f, k, w) AS (VALUES {weights}), fam(k, family, bias) AS (VALUES {names}), tp(family, t, pair, size) AS (VALUES {pairs}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
w AS (SELECT doc_id, p, regexp_extract_all(translate(line, '{upper}', '{upper.lower()}'), {_quoted(licences._WORD)}) AS w FROM l),
x AS (SELECT doc_id, p, list_distinct(w) AS u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w),
n AS (SELECT doc_id, p, sqrt(greatest(len(u) + len(b), 1)) AS root FROM x), f AS (SELECT doc_id, p, unnest(list_concat(u, b)) AS f FROM x),
s AS (SELECT doc_id, p, k, sum(w) AS s FROM f JOIN wt USING (f) GROUP BY ALL),
c AS (SELECT n.doc_id, n.p, family, (bias + coalesce(s, 0) / root) / {model.temperature!r}::DOUBLE AS score FROM n CROSS JOIN fam LEFT JOIN s ON s.doc_id = n.doc_id AND s.p = n.p AND s.k = fam.k),
m AS (SELECT *, max(score) OVER (PARTITION BY doc_id, p) AS top FROM c),
b AS (SELECT doc_id, p, arg_max(family, score) AS family, 1 / sum(exp(score - top)) AS probability FROM m GROUP BY doc_id, p),
q AS (SELECT b.doc_id, b.p, b.family, probability, t, count(*) / max(size)::DOUBLE AS share FROM b JOIN f USING (doc_id, p) JOIN tp ON tp.family = b.family AND tp.pair = f.f WHERE probability >= {least} GROUP BY ALL),
g AS (SELECT doc_id, p, family, probability, max(share) AS similarity FROM q GROUP BY ALL HAVING max(share) >= {confirm}),
d AS (SELECT doc_id, count(*) AS n_licences, list_sort(list_distinct(list(family))) AS families, string_agg(family || ':' || p, ',' ORDER BY p) AS found,
  arg_max({{'f': family, 'p': probability, 's': similarity}}, [round(probability, 12), similarity]) AS best FROM g GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN length(text) > 0 THEN len(string_split(text, chr(10))) ELSE 0 END::BIGINT AS n_paragraphs, coalesce(n_licences, 0) AS n_licences, coalesce(array_to_string(families, ','), '') AS families, coalesce(found, '') AS found,
coalesce(best.f, '{licences.UNKNOWN}') AS family, coalesce(round(best.p, 6), 0) AS probability, coalesce(round(best.s, 6), 0) AS similarity FROM documents LEFT JOIN d USING (doc_id)"""


def negatives_sql() -> str:
    return """WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label AS anchor_label, b.r AS b, b.vec_id AS id, b.label AS label, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT a, anchor_id, anchor_label, b AS p, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS n FROM s WHERE label = anchor_label) WHERE n <= 5),
m AS (SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON s.a = p.a AND s.label <> p.anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 10"""


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{words._UPPER}', '{words._LOWER}'), {_quoted(words.PATTERN)})"


def decontamination_sql() -> str:
    w = decontamination.WINDOW
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents), i AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= {w} THEN list_transform(range(1, len(w) - {w - 2}), lambda k: array_to_string(w[k:k + {w - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS win FROM i),
n AS (SELECT DISTINCT len(string_split(win, ' ')) AS n FROM v),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS win FROM d, n WHERE len(w) >= n),
o AS (SELECT r, n, pos, item_id FROM p JOIN v USING (win)),
h AS (SELECT r, count(DISTINCT pos + k) AS n_hit FROM (SELECT r, pos, unnest(range(0, n)) AS k FROM o) GROUP BY r),
g AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM o GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)"""


def search_sql() -> str:
    share, scale = ranking.SHARE, ranking.SCALE
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents), n AS (SELECT * FROM d WHERE len(w) > 0), g AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM n),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM n) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT row_number() OVER () AS i, item_id, {_words_sql('text')} AS w FROM benchmark), q AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(w) AS term FROM i) GROUP BY ALL),
x AS (SELECT q.i, q.term, times * floor(1000 * ln((2 * g.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term), g),
m AS (SELECT r, doc_id, {100 - share} + (({share} * len(w) * g.n) // g.l) AS m FROM n, g),
s AS (SELECT x.i, m.doc_id, sum(x.w * (({scale} * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM x JOIN t USING (term) JOIN m USING (r) GROUP BY x.i, m.r, m.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o JOIN i USING (i) WHERE rank <= {ranking.FIRST}"""
