"""Small functions over columns of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.functions import scalars as S, texts as X, vocabulary as V
from proofmill.plans.registry import query
from proofmill.session import table


@query(r"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS norm, trim(regexp_replace(replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '~', ' '), '\s+', ' ', 'g')) AS loose, lower(trim(regexp_replace(translate(coalesce(text, ''), '“”’–', '""''-'), '\s+', ' ', 'g'))) AS dataset_form,
rtrim(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '.') AS answer_form, left(regexp_replace(regexp_replace(trim(coalesce(text, ''), ' '), '[0-9]+', '#', 'g'), '\s+', ' ', 'g'), 60) AS shape, len(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda w: w <> ''))::INT AS n_words FROM documents""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal forms by which texts are compared."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.norm(c).alias("norm"), X.loose(c).alias("loose"), X.dataset_form(c).alias("dataset_form"), X.answer_form(c).alias("answer_form"), X.shape(c).alias("shape"), X.n_words(c).alias("n_words"))


@query(r"""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS breaks, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g'), '\w+|\s+|[^\w\s]'))::INT AS n_tokens, replace(text, ' ', '') = replace(replace(text, 'of the', 'of~the'), ' ', '') AS same_but_space FROM documents""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, runs of space and single marks of each text, and whether a tie is a change of space alone: it never is."""
    c = F.col("text")
    tied = F.replace(c, F.lit("of the"), F.lit("of~the"))
    bare = F.regexp_replace(X.text(c), "[^\\x00-\\x7F]", "x")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("long").alias("breaks"), F.size(X.tokens(bare)).alias("n_tokens"), (F.replace(c, F.lit(" "), F.lit("")) == F.replace(tied, F.lit(" "), F.lit(""))).alias("same_but_space"))


@query(f"""WITH t AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '\\usepackage{{x}} ' WHEN 1 THEN '\\title{{Y}} ' WHEN 2 THEN 'see \\cite{{z}} ' WHEN 3 THEN 'Table 3 ' WHEN 4 THEN '' WHEN 5 THEN 'et al. ' ELSE '\\begin{{figure}} ' END || p_name AS blob FROM part)
SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(blob, '{mark}') THEN '{zone}'" for zone, mark in V.ZONE_MARKS)} ELSE '{V.BODY}' END AS zone FROM t""")
def zones_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*[F.lit(m) for m in ("\\usepackage{x} ", "\\title{Y} ", "see \\cite{z} ", "Table 3 ", "", "et al. ", "\\begin{figure} ")])
    return table(spark, sf_dir, "part").select("p_partkey", X.zone_of_text(F.concat(F.element_at(marks, (F.col("p_size") % 7 + 1).cast("int")), "p_name")).alias("zone"))


@query("""SELECT event_id, 'C-1:' || CASE WHEN k % 3 = 0 THEN '-' ELSE k::VARCHAR END || ':' || left(sha256(event_type), 8) AS key FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", S.finding_key(F.lit("C-1"), F.when(k % 3 > 0, k), F.col("event_type")).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%.0f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f kB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS size
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3001 ELSE 90000001 END AS n FROM orders)""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("long") * F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 3001).otherwise(90000001)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.human_size(n).alias("size"))


@query(r"""WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'con.txt' WHEN 1 THEN url || '. ' WHEN 2 THEN 'a\b*c|' || page_id WHEN 3 THEN '../' ELSE url END AS name FROM pages),
c AS (SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(name, '^.*[/\\]', ''), '[<>:"|?*\x00-\x1f]', '_', 'g')), '[. ]+$', '') AS c FROM n)
SELECT page_id, CASE WHEN c = '' THEN 'file' WHEN regexp_matches(c, '(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\.|$)') THEN '_' || c ELSE c END AS name FROM c""")
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, url = F.col("page_id") % 5, F.col("url")
    name = F.when(n == 0, "con.txt").when(n == 1, F.concat(url, F.lit(". "))).when(n == 2, F.concat(F.lit("a\\b*c|"), F.col("page_id").cast("string"))).when(n == 3, "../").otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", S.safe_filename(name).alias("name"))


@query("""SELECT doc_id, line, regexp_matches(h, '[A-Za-z]') AND length(h) < 80 AND upper(regexp_replace(h, '[^A-Za-z]', '', 'g')) = regexp_replace(h, '[^A-Za-z]', '', 'g') AS heading
FROM (SELECT doc_id, i::INT - 1 AS line, CASE WHEN i % 2 = 1 THEN translate(lines[i], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE lines[i] END AS h FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, every other one in capitals."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(X.text(F.col("text")), "\n")).alias("line", "h"))
    h = F.when(F.col("line") % 2 == 0, F.translate("h", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("h"))
    return lines.select("doc_id", "line", S.looks_like_heading(h).alias("heading"))


@query(r"""WITH j AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'The ' || p_name || ' & <i>' || p_type || '</i>' WHEN 1 THEN 'Phys. Rev. ' || p_brand WHEN 2 THEN p_type ELSE p_name || ' - Accel., Beams' END AS name FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(regexp_replace(name, '<[^>]+>', '', 'g'), '&', ' and ')), '^\s*the\s+', ''), '[.,:;()"“”'']', ' ', 'g'), '\s*-\s*', ' ', 'g'), '\s+', ' ', 'g')) AS key, regexp_matches(name, '\b[A-Z][a-z]{0,8}\.(\s|$)') OR (upper(name) = name AND lower(name) <> name) AS abbreviated FROM j""")
def journal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 4
    name = F.when(n == 0, F.concat(F.lit("The "), "p_name", F.lit(" & <i>"), "p_type", F.lit("</i>"))).when(n == 1, F.concat(F.lit("Phys. Rev. "), "p_brand")).when(n == 2, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" - Accel., Beams")))
    return table(spark, sf_dir, "part").select("p_partkey", S.journal_key(name).alias("key"), S.looks_abbreviated(name).alias("abbreviated"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_concat([l_linenumber], range(l_linenumber + 2, l_linenumber + 3 + l_suppkey % 4), [9]), ' ') AS numbers, count(*) AS copies FROM lineitem GROUP BY ALL""")
def citation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of citations with ranges, spelt out."""
    n, to = F.col("l_linenumber"), F.col("l_linenumber") + 2 + F.col("l_suppkey") % 4
    raw = F.concat(n.cast("string"), F.lit(", "), (n + 2).cast("string"), F.lit(" – "), to.cast("string"), F.lit("; x, 9"))
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(S.citation_range(raw).cast("array<string>"), " ").alias("numbers"))
    return made.groupBy("l_orderkey", "l_linenumber", "l_partkey", "numbers").agg(F.count(F.lit(1)).alias("copies"))


@query("""SELECT o_orderkey, CASE o_custkey % 6 WHEN 3 THEN '10.1103/Ph(ys)' || o_custkey ELSE '10.1103/Phys' || o_custkey END AS doi FROM orders""")
def clean_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clings to DOIs taken off; the SQL says what must be left."""
    k, n = F.col("o_custkey").cast("string"), F.col("o_custkey") % 6
    d = F.concat(F.lit("10.1103/Phys"), k)
    raw = F.when(n == 0, F.concat(F.lit("https://doi.org/"), d, F.lit("."))).when(n == 1, F.concat(F.lit("doi: 10.1103%2FPhys"), k, F.lit("\\vskip3mm"))).when(n == 2, F.concat(d, F.lit(",journal"))).when(n == 3, F.concat(F.lit("10.1103/Ph(ys)"), k, F.lit(")).;"))).when(n == 4, F.concat(F.lit("DOI:https://dx.doi.org/"), d, F.lit("/full"))).otherwise(F.concat(d, F.lit(").),")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.clean_doi(raw).alias("doi"))


@query("""SELECT c_custkey, c_custkey % 5 < 4 AND length(c_name) > 3 AS slip FROM customer""")
def one_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names one slip away: a letter changed, gone, added, or two swapped; two letters changed are none."""
    a, n = F.col("c_name"), F.col("c_custkey") % 5
    cut = lambda i, m: F.substring(a, i, m)
    b = F.when(n == 0, F.concat(cut(1, 2), F.lit("#"), cut(4, 99))).when(n == 1, F.concat(cut(1, 2), cut(4, 99))).when(n == 2, F.concat(a, F.lit("x"))).when(n == 3, F.concat(cut(1, 1), cut(3, 1), cut(2, 1), cut(4, 99))).otherwise(F.concat(F.lit("##"), cut(3, 99)))
    return table(spark, sf_dir, "customer").select("c_custkey", S.one_slip(a, b).alias("slip"))


@query("""SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN '10.1103/A' || o_custkey WHEN 1 THEN '10.48550/arXiv.2001.0' || o_custkey WHEN 2 THEN '10.18429/JACoW-IPAC2023-MOPA' || o_custkey WHEN 3 THEN NULL ELSE '10.1000/x' || o_custkey END AS doi, o_custkey % 5 IN (0, 4) AS sure FROM orders""")
def dois_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_custkey").cast("string"), F.col("o_custkey") % 5
    at = lambda a, z="": F.concat(F.lit(a), k, F.lit(z))
    url = F.when(n == 0, at("https://doi.org/10.1103/A", ".")).when(n == 1, at("http://arxiv.org/abs/2001.0")).when(n == 2, at("https://jacow.org/ipac2023/papers/mopa", ".pdf")).when(n == 3, at("https://jacow.org/p05/papers/mopa", ".pdf")).otherwise(at("doi: 10.1000/x", ","))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.doi_of_url(url).alias("d")).select("o_orderkey", "d.doi", "d.sure")


@query("""SELECT o_orderkey, CASE WHEN y BETWEEN 1960 AND 2040 THEN 'IPAC''' || lpad((y % 100)::VARCHAR, 2, '0') END AS label FROM (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN o_custkey % 100 + CASE WHEN o_custkey % 100 > 60 THEN 1900 ELSE 2000 END ELSE 1900 + o_custkey % 200 END AS y FROM orders)""")
def conference_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    year = F.when(k % 3 == 0, F.lpad((k % 100).cast("string"), 2, "0")).otherwise((1900 + k % 200).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.label(F.concat(F.lit("in Proc. IPAC"), F.when(k % 2 == 0, "'").otherwise(" "), year, F.lit(", Venice"))).alias("label"))


@query("""SELECT doc_id, array_to_string(string_split(text, chr(10))[greatest(2 + doc_id % 3 - 1, 1) : least(2 + doc_id % 3 + 1, len(string_split(text, chr(10))))], chr(10)) AS lines FROM documents WHERE text IS NOT NULL""")
def line_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", S.excerpt(F.col("text"), (2 + F.col("doc_id") % 3).cast("int")).alias("lines"))


@query(r"""SELECT doc_id, 'see (0) and 0 in text ' || replace(t, '~', ' ') || chr(10) AS flat, t AS abstract, '\begin{document} ' || t || ' ' AS body FROM (SELECT doc_id, replace(coalesce(text, ''), '%', '') AS t FROM documents)""")
def latex_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flattened source, its abstract and its body."""
    t = F.regexp_replace(X.text(F.col("text")), "%", "")
    source = F.concat(F.lit("see \\eqref{a} and \\ref{b}~in text "), t, F.lit("% gone\n"))
    whole = F.concat(F.lit("\\usepackage{x}\n\\begin{abstract}"), t, F.lit("\\end{abstract}\\begin{document} "), t, F.lit(" \\printbibliography \\bibliography{x}"))
    return table(spark, sf_dir, "documents").select("doc_id", S.flat_latex(source).alias("flat"), S.abstract(whole).alias("abstract"), S.body(whole).alias("body"))


@query(r"""SELECT p_partkey, array_to_string(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' with ' || p_type), '[a-z0-9]+')), lambda w: length(w) >= 4 AND w NOT IN ('with', 'from', 'this', 'that', 'into', 'over')), ' ') <> '' AS has_tokens, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' of the ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS title,
upper(p_name[1]) || '. ' || upper(split_part(p_name, ' ', 2)[1]) || '.-X.' AS initials FROM part""")
def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a title is compared by, its capitals, and initials of names."""
    name = F.col("p_name")
    first, second = (F.element_at(F.split(name, " "), i) for i in (1, 2))
    return table(spark, sf_dir, "part").select("p_partkey", (F.size(S.title_tokens(F.concat(name, F.lit(" with "), F.col("p_type")))) > 0).alias("has_tokens"), S.title_case(F.concat_ws(" ", first, F.lit("Of the"), second)).alias("title"), F.array_join(S.initials(F.concat(first, F.lit(" "), second, F.lit("-x"))), " ").alias("initials"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN year(o_orderdate) WHEN o_custkey % 3 = 0 THEN 1999 END::INT AS year FROM orders""")
def reference_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.year_of(F.when(k % 2 == 0, F.col("o_orderdate").cast("string")), F.when(k % 3 == 0, "vol. 12345, May 1999.").otherwise("no 18999")).alias("year"))


@query(r"""SELECT page_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(html, '') || ' ' || url || '; see ' || url || '.', 'https?://[^\s"<>]+'), lambda u: rtrim(u, '.,;)]}')), lambda u: u <> '')))::INT AS n, page_id % 3 > 0 AS kept FROM pages""")
def urls_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses of each page, and whether a rewrite keeps them all."""
    html, url, n = X.text(F.col("html")), F.col("url"), F.col("page_id") % 3
    blob = F.concat(html, F.lit(" "), url, F.lit("; see "), url, F.lit("."))
    after = F.when(n == 0, F.lit("gone")).when(n == 1, F.upper(blob)).otherwise(blob)
    return table(spark, sf_dir, "pages").select("page_id", F.size(S.urls(blob)).alias("n"), S.keeps_links(blob, after).alias("kept"))
