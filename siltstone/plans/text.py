"""Normal forms, identities, n-grams, cues and buckets over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.plans.base import query, sql_ngrams, sql_tokens, sql_windows, sql_words, t
from siltstone.sources.storage import spread


def _documents(spark, d):
    """Documents with their text in composed form, normalised once."""
    return spread(t(spark, d, "documents").select("doc_id", "text", "n_chars")).withColumn("text", X.nfkc(F.col("text")))


@query(f"SELECT doc_id, {sql_words('text')} AS words_form, {sql_words('text', True)} AS masked_form FROM documents")
def p1_normalize(spark, d):
    return _documents(spark, d).select("doc_id", X.words_form(F.col("text"), normalise=False).alias("words_form"), X.words_form(F.col("text"), mask=True, normalise=False).alias("masked_form"))


@query(f"""SELECT doc_id, sha256({sql_words('text')}) AS exact_id, sha256({sql_words('text', True)}) AS template_id,
  len({sql_tokens('text')})::INTEGER AS n_tokens FROM documents""")
def p2_identities(spark, d):
    text = F.col("text")
    return _documents(spark, d).select("doc_id", X.identity(text, normalise=False).alias("exact_id"), X.identity(text, mask=True, normalise=False).alias("template_id"), F.size(X.tokens(text, normalise=False)).alias("n_tokens"))


@query(f"""WITH w AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)
SELECT doc_id, len({sql_ngrams('w', 5)})::INTEGER AS five_grams, len({sql_windows('w', 12)})::INTEGER AS windows,
  (CASE WHEN len(w) = 0 THEN 1 ELSE len({sql_ngrams('w', 5)}) END)::INTEGER AS selection_grams FROM w""")
def p5_ngrams(spark, d):
    w = _documents(spark, d).select("doc_id", X.tokens(F.col("text"), normalise=False).alias("w"))
    return w.select("doc_id", F.size(X.ngrams(F.col("w"), 5)).alias("five_grams"), F.size(X.windows(F.col("w"), 12)).alias("windows"), F.size(X.selection_ngrams(F.col("w"))).alias("selection_grams"))


_PAIRED = f"""u AS (SELECT conv_id, turn, {sql_tokens('text')} AS q FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, {sql_tokens('text')} AS r FROM conversations WHERE role = 'assistant')"""


@query(f"""WITH {_PAIRED}, p AS (SELECT a.conv_id, a.turn, q, r FROM a JOIN u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)
SELECT conv_id, turn,
  (least(8, len(q)) >= 5 AND q[1:least(8, len(q))] = r[1:least(8, len(q))]) AS prefix_echo,
  round(CASE WHEN len(q) = 0 OR len(r) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(q), list_distinct(r))) / len(list_distinct(q || r)) END, 6) AS overlap,
  len(list_intersect({sql_windows('q', 8)}, {sql_windows('r', 8)})) > 0 AS restates FROM p""")
def p9_overlap(spark, d):
    c = t(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), X.tokens(F.col("text")).alias("q"))
    a = c.filter("role = 'assistant'").select("conv_id", "turn", X.tokens(F.col("text")).alias("r"))
    q, r = F.col("q"), F.col("r")
    return a.join(u, ["conv_id", "turn"]).select("conv_id", "turn", X.prefix_echo(r, q).alias("prefix_echo"), F.round(X.word_overlap(q, r), 6).alias("overlap"), X.restates(q, r).alias("restates"))


_ADJACENT = " OR ".join(f"len(list_filter(range(1, len(w) - {2 * k - 2}), lambda i: w[i : i + {k - 1}] = w[i + {k} : i + {2 * k - 1}])) > 0" for k in range(2, 6))


@query(f"""WITH w AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents),
r AS (SELECT *, CASE WHEN len(w) < 9 THEN 0 ELSE list_max(map_values(list_histogram(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) END AS most FROM w)
SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0 OR most >= 3 AS repeats, {_ADJACENT} AS repeated_phrase FROM r""")
def p11_repetition(spark, d):
    w = _documents(spark, d).select("doc_id", X.tokens(F.col("text"), normalise=False).alias("w"))
    return w.select("doc_id", X.repeats(F.col("w")).alias("repeats"), X.repeated_phrase(F.col("w")).alias("repeated_phrase"))


_LISTS = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in X.CUES.items()}


@query(f"""WITH w AS (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)
SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN list_has_any(w, {v}) THEN '{k}' END" for k, v in sorted(_LISTS.items()))}) AS cues FROM w""")
def p12_cues(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(X.operation_cues(X.tokens(F.col("text"), normalise=False)), ",").alias("cues"))


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_transform(
   [CASE l_linenumber % 4 WHEN 0 THEN '+' WHEN 1 THEN 'subtract' WHEN 2 THEN 'percent' ELSE 'noop' END, CASE WHEN l_quantity > 25 THEN 'divide' ELSE 'inverse' END],
   lambda o: CASE WHEN o = '+' THEN 'addition' WHEN o = 'subtract' THEN 'subtraction' WHEN o = 'percent' THEN 'rate' WHEN o IN ('divide', 'inverse') THEN 'division' END))), ',') AS categories
FROM lineitem""")
def p13_categories(spark, d):
    n = F.col("l_linenumber") % 4
    ops = F.array(F.when(n == 0, "+").when(n == 1, "subtract").when(n == 2, "percent").otherwise("noop"), F.when(F.col("l_quantity") > 25, "divide").otherwise("inverse"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(X.formula_categories(ops), ",").alias("categories"))


_URL = "concat_ws(' ', nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'))"


@query(f"SELECT page_id, {sql_words(_URL, True)} AS fingerprint FROM pages")
def p14_url_fingerprint(spark, d):
    return t(spark, d, "pages").select("page_id", X.url_fingerprint(F.col("url")).alias("fingerprint"))


@query("""WITH u AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS p FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS r FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn, length(p) >= 24 AND contains(r, p) AS echo FROM a JOIN u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""")
def p15_prompt_echo(spark, d):
    c = t(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("p"))
    return c.filter("role = 'assistant'").join(u, ["conv_id", "turn"]).select("conv_id", "turn", X.prompt_echo(F.col("p"), F.col("text")).alias("echo"))


@query(f"""WITH w AS (SELECT doc_id, len({sql_tokens('text')}) AS n, n_chars FROM documents)
SELECT doc_id, CASE WHEN n <= 32 THEN '1_to_32' WHEN n <= 64 THEN '33_to_64' WHEN n <= 96 THEN '65_to_96' ELSE '97_plus' END AS question_bucket,
  CASE WHEN n % 5 = 0 THEN '0' WHEN n % 5 = 1 THEN '1' WHEN n % 5 = 2 THEN '2' ELSE '3_plus' END AS count_bucket,
  CASE WHEN n_chars = 0 THEN 'zero' WHEN n_chars < 10 THEN '1_to_9' WHEN n_chars < 100 THEN '10_to_99' WHEN n_chars < 1000 THEN '100_to_999' ELSE '1000_plus' END AS magnitude_bucket FROM w""")
def p19_buckets(spark, d):
    w = _documents(spark, d).select("doc_id", "n_chars", F.size(X.tokens(F.col("text"), normalise=False)).alias("n"))
    return w.select("doc_id", X.question_bucket(F.col("n")).alias("question_bucket"), X.count_bucket(F.col("n") % 5).alias("count_bucket"), X.magnitude_bucket(F.col("n_chars")).alias("magnitude_bucket"))


@query("SELECT o_orderkey, ('0x' || substr(sha256('seed:' || o_orderkey::VARCHAR), 1, 16))::UBIGINT::VARCHAR AS seed FROM orders")
def p21_seed(spark, d):
    return t(spark, d, "orders").select("o_orderkey", X.seed_of(F.lit("seed"), F.col("o_orderkey").cast("string")).cast("string").alias("seed"))


_FOLDED = "replace(lower(text), 'ß', 'ss')"
_SIGNED = "regexp_replace(regexp_replace(regexp_replace({t}, '`[^`]*`|\"[^\"]*\"|QQ[^QQ]*QQ', '<quoted>', 'g'), '(^|[^\\w.])[+-]?\\d+(?:\\.\\d+)?%?', '\\1<number>', 'g'), '\\s+', ' ', 'g')".replace("QQ", "''")


@query(f"SELECT conv_id, turn, role, sha256(trim({_SIGNED.format(t=_FOLDED)})) AS signature FROM conversations")
def p27_signature(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", "role", X.structural_signature(F.col("text")).alias("signature"))


_CUED = "concat_ws(',', " + ", ".join(f"CASE WHEN list_has_any(w, {v}) THEN '\"{k}\"' END" for k, v in sorted(_LISTS.items())) + ")"


@query(f"""WITH w AS (SELECT doc_id, {sql_tokens('text')} AS w, sha256({sql_words('text', True)}) AS n FROM documents)
SELECT doc_id, sha256('{{"number_neutral_sha256":"' || n || '","operation_cues":[' || {_CUED} || ']}}') AS structure FROM w""")
def p4_structure_hash(spark, d):
    w = _documents(spark, d).select("doc_id", X.tokens(F.col("text"), normalise=False).alias("w"), X.identity(F.col("text"), mask=True, normalise=False).alias("n"))
    return w.select("doc_id", X.structure_hash(F.col("n"), X.operation_cues(F.col("w"))).alias("structure"))


@query("""SELECT conv_id, turn, 'system' AS first_role, 'Solve it: ' || text || ' Thanks.' AS content, 2 AS n FROM conversations WHERE role = 'user' AND regexp_matches(text, '\\S')""")
def p22_prompt_render(spark, d):
    u = t(spark, d, "conversations").filter((F.col("role") == "user") & F.rlike("text", F.lit(r"\S")))
    m = u.select("conv_id", "turn", X.messages(F.col("text"), "You solve problems.", "Solve it: ", " Thanks.").alias("m"))
    return m.select("conv_id", "turn", F.col("m")[0]["role"].alias("first_role"), F.col("m")[1]["content"].alias("content"), F.size("m").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, 'Calculation: ' || CASE WHEN l_linenumber <= 6 AND length(f) <= 120 THEN f ELSE l_linenumber::VARCHAR || ' operations evaluate to ' || a || '.' END || chr(10) || 'Final answer: ' || a AS completion
FROM (SELECT *, l_partkey::VARCHAR || ' + ' || l_suppkey::VARCHAR AS f, (l_partkey + l_suppkey)::VARCHAR AS a FROM lineitem)""")
def p23_completion(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    formula, total = F.concat(p.cast("string"), F.lit(" + "), s.cast("string")), (p + s).cast("string")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.built_completion(formula, F.col("l_linenumber"), total).alias("completion"))


@query("""SELECT conv_id, turn, to_json({'role': role, 'meta': {'length': length(text)}, 'parts': [{'k': turn}]})::VARCHAR AS record FROM conversations""")
def p24_content_free(spark, d):
    """A nested record of which every field with content goes."""
    c = t(spark, d, "conversations").select("conv_id", "turn", F.struct("role", "text", F.struct(F.length("text").alias("length"), F.col("text").alias("prompt")).alias("meta"), F.array(F.struct(F.col("turn").alias("k"), F.col("text").alias("answer"))).alias("parts")).alias("r"))
    return c.select("conv_id", "turn", F.to_json(X.content_free(c.schema["r"].dataType, F.col("r"))).alias("record"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber // gcd(l_quantity::INT, l_linenumber) = 1 THEN (l_quantity::INT // gcd(l_quantity::INT, l_linenumber))::VARCHAR
  ELSE (l_quantity::INT // gcd(l_quantity::INT, l_linenumber))::VARCHAR || '/' || (l_linenumber // gcd(l_quantity::INT, l_linenumber))::VARCHAR END AS ratio FROM lineitem""")
def p25_serialized(spark, d):
    """Quantities over line numbers in lowest terms (line numbers are few, so the
    common divisor is found among them)."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    g = F.array_max(F.filter(F.sequence(F.lit(1), n), lambda k: (q % k == 0) & (n % k == 0)))
    li = t(spark, d, "lineitem").withColumn("g", g)
    return li.select("l_orderkey", "l_linenumber", X.serialized((q / F.col("g")).cast("long"), (n / F.col("g")).cast("long")).alias("ratio"))
