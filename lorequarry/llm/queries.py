"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, exactdedup, fim, htmltext, langid, licenses, linededup, mixing, neardup, runs, secrets, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.CONTRACT)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id"), langid.FOLDS, langid.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder for each source, in it one for each thousand ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    found = licenses.scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"))
    return found.withColumnRenamed("id", "doc_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.training_rows(labels))
    held_out = langid.held_out(F.col("doc_id"), toxicity.FOLDS, toxicity.HELD_OUT)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_exactdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find(table(spark, sf_dir, "documents"), runs.CONTRACT))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_htmltext": op1_htmltext,
    "op2_neardup": op2_neardup,
    "op3_decontaminate": op3_decontaminate,
    "op4_linededup": op4_linededup,
    "op5_langid": op5_langid,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_secrets": op8_secrets,
    "op9_ann": op9_ann,
    "op10_toxicity": op10_toxicity,
    "op11_exactdedup": op11_exactdedup,
    "op12_runs": op12_runs,
    "op13_fim": op13_fim,
}

MIX_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(sha256('7:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
           / (CASE q.quality WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 1.0 END) AS key
  FROM {documents} d LEFT JOIN q ON q.doc_id = d.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST((n - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0 * CAST(source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
         (CAST(sum(source_size) OVER () AS DOUBLE) - sum(cap) OVER upto + cap) / (sum(weight) OVER () - sum(weight) OVER upto + weight) AS level
  FROM w WINDOW upto AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)), cap) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (
  SELECT d.doc_id, d.size, d.source, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source, source_size, target,
       CAST(size * whole + CASE WHEN before + size / 2.0 <= rest THEN size ELSE 0 END AS BIGINT) AS taken,
       CAST(whole + CASE WHEN size > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END AS BIGINT) AS epochs
FROM p
"""

#: All pairs of documents that share a shingle and are of like size; components by reachability.
NEARDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON m.doc_id = s.doc_id
"""

#: Pairs of lines that share a shingle among the rarest fifth of both, which a pair of 0.8 must; then their full sets.
LINES_SQL = r"""
WITH RECURSIVE x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
y AS (SELECT doc_id, line_no, lower(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS k FROM x),
z AS (SELECT * FROM y WHERE k <> ''),
k AS (SELECT k, row_number() OVER (ORDER BY k) AS id, CASE WHEN length(k) < 7 THEN [k] ELSE list_distinct(list_transform(range(1, length(k) - 5), lambda i: k[i : i + 6])) END AS s FROM (SELECT DISTINCT k FROM z)),
e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM k),
f AS (SELECT x, count(*) AS f FROM e GROUP BY x),
g AS (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY f.f, e.x) AS pos FROM e JOIN f ON f.x = e.x),
q AS (SELECT * FROM g WHERE pos <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM q a JOIN q b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
p AS (SELECT c.a, c.b, len(list_intersect(ka.s, kb.s)) AS i, len(ka.s) AS na, len(kb.s) AS nb FROM c JOIN k ka ON ka.id = c.a JOIN k kb ON kb.id = c.b),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS c FROM k UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
m AS (SELECT k.k, min(r.c) AS c FROM r JOIN k ON k.id = r.id GROUP BY k.k),
o AS (SELECT z.doc_id, z.line_no, row_number() OVER (PARTITION BY m.c ORDER BY z.doc_id, z.line_no) AS n FROM z JOIN m ON m.k = z.k),
t AS (SELECT x.doc_id, x.line_no, x.line, coalesce(o.n, 1) = 1 AS stays, o.n IS NOT NULL AS counts FROM x LEFT JOIN o ON o.doc_id = x.doc_id AND o.line_no = x.line_no),
j AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (stays), '') AS text, CAST(count(*) FILTER (counts) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_removed FROM t GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN j.n_removed = 0 THEN d.text WHEN trim(j.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN '' ELSE j.text END AS text, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id
"""


def license_sql() -> str:
    """Every line, paragraph and text against every template."""
    rows = ", ".join(f"({k}, '{name}', $t${text}$t$)" for k, (name, text) in enumerate((n, x) for n, v in licenses.TEMPLATES.items() for x in v))
    split = lambda x: f"unnest(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
    return rf"""
WITH notice(template, license, text) AS (VALUES {rows}),
tpl AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, {split("text")} AS term FROM notice) GROUP BY ALL),
d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, 0 AS kind, 0 AS no, text AS part FROM d
  UNION ALL SELECT doc_id, 1, unnest(range(0, len(p))), unnest(p) FROM (SELECT doc_id, string_split_regex(text, '
[ 	
]*
') AS p FROM d)
  UNION ALL SELECT doc_id, 2, unnest(range(0, len(p))), unnest(p) FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM d)),
w AS (SELECT doc_id, kind, no, {split("part")} AS term FROM parts),
t AS (SELECT doc_id, kind, no, term, count(*) AS tf FROM w GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + coalesce(k, 0))) + 1 AS idf FROM (SELECT term FROM t UNION SELECT term FROM tpl) v LEFT JOIN (SELECT term, count(*) AS k FROM t WHERE kind = 0 GROUP BY term) c USING (term)),
x AS (SELECT t.doc_id, t.kind, t.no, t.term, t.tf * i.idf AS x FROM t JOIN idf i ON i.term = t.term),
norm AS (SELECT doc_id, kind, no, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
tw AS (SELECT tpl.template, tpl.license, tpl.term, tpl.tf * i.idf AS w FROM tpl JOIN idf i ON i.term = tpl.term),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
c AS (SELECT x.doc_id, x.kind, x.no, tw.template, tw.license, sum(x.x * tw.w) / any_value(norm.norm) / any_value(tn.norm) AS cosine FROM x JOIN tw ON tw.term = x.term JOIN tn ON tn.template = tw.template
  JOIN norm ON norm.doc_id = x.doc_id AND norm.kind = x.kind AND norm.no = x.no GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 9) DESC, kind, template, no) AS r FROM c WHERE cosine >= {licenses.MIN_COSINE}),
f AS (SELECT a.doc_id, concat_ws('/', a.source, CAST(a.doc_id // 1000 AS VARCHAR), CAST(a.doc_id AS VARCHAR)) AS path, concat_ws('/', a.source, CAST(a.doc_id // 1000 AS VARCHAR)) AS folder,
  b.license, round(b.cosine, 6) AS cosine, CASE b.kind WHEN 0 THEN 'file' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'line' END AS unit FROM documents a LEFT JOIN b ON b.doc_id = a.doc_id AND b.r = 1),
l AS (SELECT folder, license, row_number() OVER (PARTITION BY folder ORDER BY cosine DESC, path) AS r FROM f WHERE unit = 'file'),
n AS (SELECT f.doc_id, l.folder AS up, l.license, row_number() OVER (PARTITION BY f.doc_id ORDER BY length(l.folder) DESC) AS r FROM f JOIN l ON l.r = 1 AND (l.folder = f.folder OR starts_with(f.folder, concat(l.folder, '/'))))
SELECT f.doc_id, f.path, f.license, f.cosine, f.unit, CASE WHEN f.license IS NULL THEN n.license END AS inherited, CASE WHEN f.license IS NULL THEN n.up END AS inherited_from FROM f LEFT JOIN n ON n.doc_id = f.doc_id AND n.r = 1
"""


def leaks_sql() -> str:
    """Windows as text, with no hashing; the rest is as the operator defines it."""
    d = decontaminate
    words, units, starters = (", ".join(f"'{w}'" for w in ws) for ws in (d.NUMBER_WORDS, d.UNITS, d.STARTERS))
    # RE2 knows no possessive repetition; nothing follows these groups, so a greedy one is the same
    figures, names = (p.replace("*+", "*").replace("'", "''") for p in (d.FIGURES, d.NAMES))
    every_word = d.WORDS.replace("'", "''")

    def mark(text: str, values: bool, view: str) -> str:
        v = (lambda k: f"\\{k}") if values else (lambda k: "")
        out = f"regexp_replace({text}, '{figures}', ' {d.NUMBER}{v(0)}{d.END} ', 'g')"
        return f"lower({out})" if view == d.PLAIN else f"lower(regexp_replace({out}, '{names}', '\\1 {d.NAME}{v(2)}{d.END} ', 'g'))"

    def typed(tokens: str, values: bool) -> str:
        m = lambda k: f"concat('{k}', t)" if values else f"'{k}'"
        number = f"({tokens}[i - 1][1] = '{d.NUMBER}' OR {tokens}[i - 1] IN ({words}))"
        return f"list_transform({tokens}, lambda t, i: CASE WHEN t IN ({words}) THEN {m(d.NUMBER)} WHEN t IN ({units}) AND i > 1 AND {number} THEN {m(d.UNIT)} ELSE t END)"

    by_view = lambda f: f"CASE view WHEN '{d.PLAIN}' THEN {f(d.PLAIN)} ELSE {f(d.CAPITALS)} END"
    raw = lambda c: f"list_filter(string_split_regex({by_view(lambda v: mark(c, False, v))}, '{d.SPLIT}'), lambda x: x <> '')"
    val = lambda c: f"regexp_extract_all({by_view(lambda v: mark(c, True, v))}, '{d.VALUES}')"
    shape = lambda x: f"(CASE WHEN {x}[1] IN ('{d.NUMBER}', '{d.NAME}', '{d.UNIT}') THEN {x}[1] ELSE {x} END)"
    share = f"(n_covered >= {d.MIN_COVER} * n_tokens OR n_covered >= {d.ENOUGH_TOKENS})"
    return f"""
WITH i0 AS (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ww AS (SELECT DISTINCT text, unnest(regexp_extract_all(text, '{every_word}')) AS word FROM i0),
low AS (SELECT DISTINCT word FROM ww WHERE regexp_matches(word, '^\\p{{Ll}}') UNION SELECT unnest([{starters}])),
common AS (SELECT text, list(DISTINCT lower(word)) AS common FROM ww WHERE regexp_matches(word, '^\\p{{Lu}}') AND lower(word) IN (SELECT word FROM low) GROUP BY text),
w0 AS (SELECT item_id, text, '{d.PLAIN}' AS view, 0 AS skip, text AS wording FROM i0 UNION ALL SELECT item_id, text, '{d.PLAIN}', 1, concat('5 ', text) FROM i0
  UNION ALL SELECT item_id, text, '{d.CAPITALS}', 0, text FROM i0 UNION ALL SELECT item_id, text, '{d.CAPITALS}', 0, concat(lower(text[1:1]), text[2:]) FROM i0),
w1 AS (SELECT *, {raw("wording")} AS k, {val("wording")} AS kv FROM w0),
w2 AS (SELECT item_id, text, view, skip, wording, {typed("k", False)}[skip + 1 :] AS t, {typed("kv", True)}[skip + 1 :] AS ours FROM w1),
w3 AS (SELECT *, row_number() OVER (PARTITION BY item_id, view, text, t ORDER BY skip, wording) AS again FROM w2),
i3 AS (SELECT w3.*, concat(view, ':', wording) AS version, len(t) AS n_tokens, least(len(t), {d.WINDOW}) AS width, coalesce(common, []) AS common FROM w3 LEFT JOIN common ON common.text = w3.text WHERE again = 1 AND len(t) >= {d.MIN_TOKENS}),
iw AS (SELECT item_id, view, version, width, unnest(range(0, n_tokens - width + 1)) AS item_pos, unnest(list_transform(range(1, n_tokens - width + 2), lambda q: array_to_string(t[q : q + width - 1], ' '))) AS h FROM i3),
d0 AS (SELECT doc_id, text, view FROM documents, (VALUES ('{d.PLAIN}'), ('{d.CAPITALS}')) AS v(view) WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d1 AS (SELECT doc_id, view, {raw("text")} AS k, {val("text")} AS kv FROM d0),
d2 AS (SELECT doc_id, view, {typed("k", False)} AS t, {typed("kv", True)} AS theirs FROM d1),
dw AS (SELECT doc_id, d2.view, width, unnest(range(0, len(t) - width + 1)) AS pos, unnest(list_transform(range(1, len(t) - width + 2), lambda q: array_to_string(t[q : q + width - 1], ' '))) AS h FROM d2, (SELECT DISTINCT width FROM i3) w WHERE len(t) >= width),
hits AS (SELECT dw.doc_id, iw.item_id, iw.view, iw.version, iw.width, iw.item_pos, dw.pos - iw.item_pos AS shift FROM dw JOIN iw ON iw.h = dw.h AND iw.width = dw.width AND iw.view = dw.view),
s AS (SELECT doc_id, item_id, version, shift, row_number() OVER (PARTITION BY doc_id, item_id, version ORDER BY count(*) DESC, shift) AS r FROM hits GROUP BY doc_id, item_id, version, shift),
p AS (SELECT DISTINCT doc_id, item_id, version, width, item_pos FROM hits),
g AS (SELECT *, least(width, coalesce(lead(item_pos) OVER (PARTITION BY doc_id, item_id, version ORDER BY item_pos) - item_pos, width)) AS c FROM p),
c AS (SELECT doc_id, item_id, version, CAST(sum(c) AS INTEGER) AS n_covered FROM g GROUP BY ALL),
j AS (SELECT c.*, s.shift, i3.view, i3.n_tokens, i3.ours, i3.common, d2.theirs FROM c JOIN s ON s.r = 1 AND s.doc_id = c.doc_id AND s.item_id = c.item_id AND s.version = c.version
  JOIN i3 ON i3.item_id = c.item_id AND i3.version = c.version JOIN d2 ON d2.doc_id = c.doc_id AND d2.view = i3.view WHERE {share} OR (i3.view = '{d.PLAIN}' AND n_covered >= {d.VERBATIM_RUN})),
x0 AS (SELECT doc_id, item_id, version, view, n_tokens, n_covered, common, ours, theirs, shift, unnest(range(1, len(ours) + 1)) AS i FROM j),
x AS (SELECT doc_id, item_id, version, view, n_tokens, n_covered, common, i, ours[i] AS x, CASE WHEN shift + i >= 1 THEN theirs[shift + i] END AS y FROM x0),
q AS (SELECT doc_id, item_id, version, max(n) AS run FROM (SELECT doc_id, item_id, version, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, version ORDER BY i) AS island FROM x WHERE x = y) GROUP BY doc_id, item_id, version, island) GROUP BY ALL),
a AS (SELECT *, x[1] IN ('{d.NUMBER}', '{d.NAME}', '{d.UNIT}') AS slot, x[1] = '{d.NAME}' AND list_contains(common, string_split(x[2:], ' ')[1]) AND NOT list_contains(string_split(y[2:], ' '), string_split(x[2:], ' ')[1]) AS other FROM x WHERE y IS NOT NULL AND {shape("x")} = {shape("y")}),
f AS (SELECT doc_id, item_id, version, view, n_tokens, n_covered, count(*) FILTER (slot) AS n_slots, count(*) FILTER (NOT slot) AS literals, count(DISTINCT x) FILTER (slot) AS nx, count(DISTINCT y) FILTER (slot) AS ny, count(DISTINCT concat(x, chr(1), y)) FILTER (slot) AS nxy, coalesce(bool_or(slot AND x <> y), false) AS differ, bool_or(other) AS other FROM a GROUP BY ALL),
k AS (SELECT f.*, coalesce(q.run, 0) AS run, {share} AND literals >= {d.MIN_LITERALS} AND (n_slots = 0 OR (nx + ny) / (2.0 * nxy) >= {d.MIN_CONSISTENCY}) AS copied FROM f LEFT JOIN q ON q.doc_id = f.doc_id AND q.item_id = f.item_id AND q.version = f.version WHERE NOT other),
m AS (SELECT *, CASE WHEN differ AND copied THEN 'reparameterised' ELSE 'verbatim' END AS kind FROM k WHERE copied OR run = n_tokens OR (view = '{d.PLAIN}' AND run >= {d.VERBATIM_RUN})),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_covered DESC, n_tokens, kind DESC, n_slots) AS r FROM m)
SELECT doc_id, item_id, CAST(n_tokens AS INTEGER) AS n_tokens, n_covered, CAST(n_slots AS INTEGER) AS n_slots, kind FROM b WHERE r = 1
"""


EXACT_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

#: The crc32 of the id is folded bit by bit. Every pair of equal words of a document that are a period apart belongs to one
#: stretch of that period; of stretches with the same bounds the one of the smallest period is a run.
RUNS_SQL = r"""
WITH c AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 % len(w) AS a, h // 10 % 8 AS k FROM c),
v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + k)) END]) ELSE w END AS w FROM g),
e AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS x FROM v WHERE n >= 24),
m AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i JOIN v ON v.doc_id = a.doc_id AND b.i - a.i <= v.n // 3),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM m) GROUP BY doc_id, p, island),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s WHERE length >= greatest(24, 3 * p) GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM r),
d AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT v.doc_id, CASE WHEN t.doc_id IS NULL THEN array_to_string(v.w, ' ') ELSE coalesce((SELECT string_agg(e.x, ' ' ORDER BY e.i) FROM e ANTI JOIN d ON d.doc_id = e.doc_id AND d.i = e.i WHERE e.doc_id = v.doc_id), '') END AS collapsed FROM v LEFT JOIN t ON t.doc_id = v.doc_id)
SELECT k.doc_id, coalesce(t.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(k.collapsed) AS collapsed_sha256
FROM k LEFT JOIN t ON t.doc_id = k.doc_id LEFT JOIN b ON b.doc_id = k.doc_id AND b.place = 1
"""

FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS h FROM documents),
u AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT doc_id, t, n, form, a, b, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', substr(t, 1, a), '<S>', substr(t, b + 1), '<M>', substr(t, a + 1, b - a))
  ELSE concat('<S>', substr(t, b + 1), '<P>', substr(t, 1, a), '<M>', substr(t, a + 1, b - a)) END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

ORACLES: dict[str, str] = {
    "op2_neardup": NEARDUP_SQL,
    "op3_decontaminate": leaks_sql(),
    "op4_linededup": LINES_SQL,
    "op6_mixing": MIX_SQL.format(documents="documents"),
    "op7_licenses": license_sql(),
    "op11_exactdedup": EXACT_SQL,
    "op12_runs": RUNS_SQL,
    "op13_fim": FIM_SQL,
}
