"""Named queries: each applies one operator to the relational tables, with the same question as plain SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline import refdata as R
from sieveline.functions import text as T
from sieveline.functions import urls as U
from sieveline.functions.entropy import text_entropy
from sieveline.functions.sql import register
from sieveline.limits import Limits
from sieveline.operators import capping, dimensions, lookup, reports, tagging
from sieveline.operators import fragments as fragment_joins
from sieveline.plans import inventory, rules
from sieveline.plans.evidence import class_evidence, literal_facts
from sieveline.plans.triage import decoded, findings_of
from sieveline.sources import descriptors
from sieveline.sources.build import archives_of, packed
from sieveline.sources.reports import documents as file_reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _within(domains) -> str:
    return "(" + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in domains) + ")"


HOST_SQL = r"rtrim(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)', 1), '[\[\]]', '', 'g'), '.')"

# --- URLs -------------------------------------------------------------------------------------------

URL_CASE = f"""
  CASE WHEN regexp_matches(low, '{R.WEBHOOK_WHOLE}') THEN 'WARNING|HIGH|Discord webhook'
       WHEN regexp_matches(low, '{R.WEBHOOK}') THEN 'REVIEW|MEDIUM|webhook address without its token'
       WHEN contains(low, 'api.telegram.org/bot') THEN 'WARNING|HIGH|Telegram bot API'
       WHEN regexp_matches(host, '^(10\\.|127\\.|0\\.|192\\.168\\.)[0-9.]+$') THEN 'INFO|HIGH|local or private address'
       WHEN regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN 'REVIEW|MEDIUM|bare IP address'
       WHEN host IN ('cdn.discordapp.com', 'media.discordapp.net') AND contains(low, '/attachments/') THEN 'REVIEW|MEDIUM|chat attachment'
       WHEN {_within(R.PASTE_DOMAINS)} THEN 'REVIEW|MEDIUM|paste site'
       WHEN {_within(R.TUNNEL_DOMAINS)} THEN 'REVIEW|MEDIUM|tunnel or dynamic DNS'
       WHEN {_within(R.FILE_HOST_DOMAINS)} THEN 'REVIEW|MEDIUM|anonymous file host'
       WHEN {_within(R.IP_LOOKUP_DOMAINS)} THEN 'REVIEW|MEDIUM|public IP lookup'
       WHEN {_within(R.SHORTENER_DOMAINS)} THEN 'REVIEW|LOW|URL shortener'
       WHEN regexp_matches(host, '\\.(cf|ga|gq|ml|tk)$') THEN 'REVIEW|LOW|free top-level domain'
       WHEN {_within(R.KNOWN_DOMAINS)} THEN 'INFO|HIGH|well-known domain'
       ELSE 'INFO|MEDIUM|other domain' END
"""
#: The tables' hosts are invented; every seventh page is read under a host that some list knows.
STAND_INS = ["pastebin.com", "api.telegram.org/bot", "x.ngrok.io", "gofile.io", "bit.ly", "ipinfo.io", "evil.tk", "raw.githubusercontent.com", "10.0.0.7", "93.184.216.34", "discord.com/api/v10/webhooks/12/ab-c", "discord.com/api/webhooks", "cdn.discordapp.com/attachments", "example.ml.org"]


def _url_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = F.array(*map(F.lit, STAND_INS))
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    other = F.concat(F.lit("https://"), F.element_at(hosts, (F.expr("page_id div 7") % len(STAND_INS) + 1).cast("int")), path)
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, other).otherwise(F.col("url")).alias("url"))


URL_ROWS = f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'https://' || ([{_quoted(STAND_INS)}])[CAST((page_id // 7) % {len(STAND_INS)} + 1 AS INTEGER)] || regexp_replace(url, '^[a-z]+://[^/]*', '') ELSE url END AS url FROM pages"""


@query(f"""
WITH urls AS ({URL_ROWS}), hosts AS (SELECT page_id, url, lower(url) AS low, {HOST_SQL} AS host FROM urls), v AS (SELECT page_id, host, {URL_CASE} AS verdict FROM hosts)
SELECT page_id, host, split_part(verdict, '|', 1) AS severity, split_part(verdict, '|', 2) AS confidence, split_part(verdict, '|', 3) AS label FROM v""")
def url_classify(spark, sf_dir):
    v = U.classify_url(F.col("url"))
    return _url_rows(spark, sf_dir).select("page_id", U.host_of(F.col("url")).alias("host"), v["severity"].alias("severity"), v["confidence"].alias("confidence"), v["label"].alias("label"))


@query(f"""
WITH urls AS ({URL_ROWS}), hosts AS (SELECT page_id, url, lower(url) AS low, {HOST_SQL} AS host FROM urls), v AS (SELECT {URL_CASE} AS verdict FROM hosts)
SELECT split_part(verdict, '|', 1) AS severity, split_part(verdict, '|', 3) AS label, count(*) AS n FROM v GROUP BY ALL""")
def url_severity_counts(spark, sf_dir):
    v = U.classify_url(F.col("url"))
    return _url_rows(spark, sf_dir).groupBy(v["severity"].alias("severity"), v["label"].alias("label")).agg(F.count("*").alias("n"))


@query(f"""
WITH hosts AS (SELECT page_id, {HOST_SQL} AS host FROM pages), counts AS (SELECT host, count(*) AS n, min(page_id) AS first_seq FROM hosts GROUP BY host)
SELECT host, n, first_seq, row_number() OVER (ORDER BY n DESC, first_seq) AS place FROM counts""")
def url_host_inventory(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", U.host_of(F.col("url")).alias("host"))
    return reports.most_common(rows, [], "host", "page_id").select("host", "n", "first_seq", "place")


SUFFIX_SQL = f"""
WITH hosts AS (SELECT page_id, {HOST_SQL} AS host FROM pages),
parts AS (SELECT page_id, host, string_split(host, '.') AS p FROM hosts),
tails AS (SELECT page_id, unnest([array_to_string(p[k:], '.') for k in range(1, len(p) + 1)]) AS domain FROM parts)
SELECT domain, count(*) AS n FROM tails WHERE domain IN ('example.com', 'example.net', 'example.org', 'tionsh.example.net') GROUP BY domain"""


@query(SUFFIX_SQL)
def domain_suffix_join(spark, sf_dir):
    dim = spark.sql("SELECT * FROM VALUES ('example.com'), ('example.net'), ('example.org'), ('tionsh.example.net') AS t(domain)")
    tails = table(spark, sf_dir, "pages").select("page_id", F.explode(U.suffixes(U.host_of(F.col("url")))).alias("domain"))
    return tails.join(dim, "domain").groupBy("domain").agg(F.count("*").alias("n"))




def _path():
    return F.regexp_replace(F.regexp_replace(F.col("url"), r"[?#].*$", ""), r"^[a-z]+://", "")


PATH_SQL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '')"


@query(f"""
WITH p AS (SELECT page_id, regexp_extract({PATH_SQL}, '[^/]*$') AS base FROM pages), e AS (SELECT page_id, lower(regexp_extract(base, '^\\.*[^.].*(\\.[^.]*)$', 1)) AS ext FROM p),
c AS (SELECT CASE WHEN ext = '' THEN '(none)' ELSE ext END AS ext, count(*) AS n, min(page_id) AS first_seq FROM e GROUP BY 1)
SELECT ext, n, first_seq, row_number() OVER (ORDER BY n DESC, first_seq) AS place FROM c""")
def path_extension_inventory(spark, sf_dir):
    ext = T.extension_of(_path())
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(ext == "", "(none)").otherwise(ext).alias("ext"))
    return reports.most_common(rows, [], "ext", "page_id").select("ext", "n", "first_seq", "place")


@query(f"""
WITH p AS (SELECT string_split({PATH_SQL}, '/') AS p FROM pages)
SELECT CASE WHEN len(p) = 1 THEN '(default package)' WHEN len(p) = 2 THEN p[1] ELSE p[1] || '/' || p[2] END AS package, count(*) AS n FROM p GROUP BY 1""")
def path_top_package(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.top_package(_path()).alias("package")).agg(F.count("*").alias("n"))


@query(r"""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || url WHEN 1 THEN 'a/../' || url WHEN 2 THEN 'C:' || url WHEN 3 THEN 'a\b' ELSE url END AS name FROM pages)
SELECT page_id, starts_with(name, '/') OR contains(name, chr(92)) OR regexp_matches(name, '^[A-Za-z]:') OR list_contains(string_split(name, '/'), '..') AS unsafe,
  regexp_extract(name, '[^/]*$') AS base FROM p""")
def unsafe_paths(spark, sf_dir):
    k = F.col("page_id") % 5
    name = F.when(k == 0, F.concat(F.lit("/"), F.col("url"))).when(k == 1, F.concat(F.lit("a/../"), F.col("url"))).when(k == 2, F.concat(F.lit("C:"), F.col("url"))).when(k == 3, F.lit("a\\b")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.is_unsafe_path(name).alias("unsafe"), T.base_name(name).alias("base"))


# --- text -------------------------------------------------------------------------------------------

IP = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
_RANGES = " OR ".join(f"n BETWEEN {U._number(a)} AND {U._number(b)}" for a, b in R.PRIVATE_IPV4)
IP_SQL = rf"""
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{IP}')) AS ip FROM documents),
valid AS (SELECT doc_id, ip, string_split(ip, '.') AS p FROM found WHERE regexp_matches(ip, '^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$')),
num AS (SELECT doc_id, ip, CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536 + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT) AS n FROM valid WHERE greatest(CAST(p[1] AS INT), CAST(p[2] AS INT), CAST(p[3] AS INT), CAST(p[4] AS INT)) <= 255)
SELECT DISTINCT doc_id, ip, NOT ({_RANGES}) AS is_public FROM num"""


def public_addresses(rows: DataFrame) -> DataFrame:
    """doc_id, ip, is_public for rows of (doc_id, value)."""
    found = rows.select("doc_id", F.explode(F.regexp_extract_all("value", F.lit(IP), F.lit(0))).alias("ip"))
    n = U.ipv4_number(F.col("ip"))
    return found.filter(n.isNotNull()).select("doc_id", "ip", (~U.is_private_ipv4(n)).alias("is_public")).distinct()


@query(IP_SQL)
def ip_extract_public(spark, sf_dir):
    return public_addresses(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")))


ENTROPY_SQL = """
  (SELECT round(-sum(c / t.n * log2(c / t.n)), 6) FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM (SELECT unnest(string_split({x}, '')) AS ch) GROUP BY ch), (SELECT CAST(length({x}) AS DOUBLE) AS n) t)"""


@query("""
WITH chars AS (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark), counts AS (SELECT item_id, ch, CAST(count(*) AS DOUBLE) AS c FROM chars GROUP BY ALL), n AS (SELECT item_id, sum(c) AS n FROM counts GROUP BY 1)
SELECT item_id, round(-sum(c / n * log2(c / n)), 6) AS bits FROM counts JOIN n USING (item_id) GROUP BY item_id""")
def entropy_by_item(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(T.shannon_entropy(F.col("text")), 6).alias("bits"))


@query("""
WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), counts AS (SELECT doc_id, ch, CAST(count(*) AS DOUBLE) AS c FROM chars GROUP BY ALL), n AS (SELECT doc_id, sum(c) AS n FROM counts GROUP BY 1)
SELECT doc_id, round(-sum(c / n * log2(c / n)), 6) AS bits FROM counts JOIN n USING (doc_id) GROUP BY doc_id""")
def entropy_by_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.round(text_entropy("text"), 6).alias("bits"))


TOKEN = "[A-Za-z0-9+/_-]{40,}={0,2}"


@query(f"""
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents), tokens AS (SELECT DISTINCT doc_id, token FROM found),
chars AS (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM tokens), counts AS (SELECT doc_id, token, ch, CAST(count(*) AS DOUBLE) AS c FROM chars GROUP BY ALL),
bits AS (SELECT doc_id, token, -sum(c / length(token) * log2(c / length(token))) AS bits FROM counts GROUP BY doc_id, token)
SELECT doc_id, token, round(bits, 6) AS bits, regexp_matches(token, '[a-z]') AND regexp_matches(token, '[A-Z]') AND regexp_matches(token, '[0-9]') AND bits >= CASE WHEN length(token) < 100 THEN 4.5 ELSE 5.0 END AS encoded FROM bits""")
def encoded_tokens(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token")).distinct()
    t, bits = F.col("token"), T.shannon_entropy(F.col("token"))
    mixed = t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9]")
    return found.select("doc_id", "token", F.round(bits, 6).alias("bits"), (mixed & (bits >= F.when(F.length(t) < 100, 4.5).otherwise(5.0))).alias("encoded"))


@query("""
WITH data AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'MZ' WHEN 1 THEN 'PK' || chr(3) || chr(4) WHEN 2 THEN chr(127) || 'ELF' WHEN 3 THEN '' ELSE 'text ' END || CASE WHEN p_partkey % 5 = 3 THEN '' ELSE p_name END AS s FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Windows executable (PE)' WHEN 1 THEN 'ZIP/JAR archive' WHEN 2 THEN 'Linux executable (ELF)' WHEN 3 THEN 'empty file' ELSE 'unknown' END AS magic, TRUE AS same, hex(encode(s)) AS data FROM data""")
def base64_roundtrip_magic(spark, sf_dir):
    k = F.col("p_partkey") % 5
    head = F.when(k == 0, "MZ").when(k == 1, "PK\x03\x04").when(k == 2, "\x7fELF").when(k == 3, "").otherwise("text ")
    s = F.encode(F.concat(head, F.when(k == 3, "").otherwise(F.col("p_name"))), "UTF-8")
    rows = table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).withColumn("coded", F.translate(F.rtrim(F.base64("s"), F.lit("=")), "+/", "-_"))
    back = T.try_base64(F.col("coded"))
    return rows.select("p_partkey", T.magic_of(back, R.MAGIC).alias("magic"), F.coalesce(back == F.col("s"), F.lit(False)).alias("same"), F.hex(back).alias("data"))


@query(r"""
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(8238) || 'x' WHEN 1 THEN text || chr(9) || chr(7) ELSE text END AS text FROM documents)
SELECT doc_id, contains(text, chr(8238)) AS deceptive, regexp_replace(replace(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…[truncated]' ELSE text END, chr(9), ' '), '\p{C}', '�', 'g') AS shown FROM t""")
def safe_texts(spark, sf_dir):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat("text", F.lit("‮x"))).when(k == 1, F.concat("text", F.lit("\t\x07"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.has_deceptive_chars(text).alias("deceptive"), T.safe_text(text).alias("shown"))


TERMS = {"licensed under": "licence", "gnu general public license": "licence", "apache license": "licence", "token =": "credential", "stupid": "insult", "worthless": "insult", "trash": "insult", "disgusting": "insult"}


@query(f"""
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{"|".join(TERMS)}')) AS term FROM documents),
dim(term, category) AS (VALUES {", ".join(f"('{t}', '{c}')" for t, c in TERMS.items())})
SELECT category, term, count(*) AS hits, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM found JOIN dim USING (term) GROUP BY category, term""")
def sensitive_terms(spark, sf_dir):
    dim = spark.sql(f"SELECT * FROM VALUES {', '.join(f'({t!r}, {c!r})' for t, c in TERMS.items())} AS t(term, category)")
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("|".join(TERMS)), F.lit(0))).alias("term"))
    return found.join(dim, "term").groupBy("category", "term").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("""
WITH words AS (SELECT doc_id, length(w) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents)),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (n <= 2) AS n_short FROM words GROUP BY doc_id)
SELECT doc_id, n, n_short, round(CAST(n_short AS DOUBLE) / n, 6) AS ratio, CASE WHEN n >= 10 AND CAST(n_short AS DOUBLE) / n >= 0.5 THEN 'obfuscated' WHEN CAST(n_short AS DOUBLE) / n >= 0.2 AND n_short >= 10 THEN 'partly' ELSE 'plain' END AS verdict FROM s""")
def obfuscation_ratio(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    return reports.short_name_ratio(words, ["doc_id"], F.col("w"))


# --- lookups and joins ------------------------------------------------------------------------------


@query("""
WITH dim AS (SELECT sha256(d.text) AS sha, CASE WHEN max(toxic) = 1 THEN 'SUSPICIOUS' WHEN min(quality) = 1 THEN 'VERIFIED' END AS classification FROM documents d JOIN labels l USING (doc_id) GROUP BY 1)
SELECT doc_id, sha256(text) AS sha, coalesce(classification, 'UNKNOWN') AS classification FROM documents LEFT JOIN dim ON sha256(text) = sha""")
def hash_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    of = F.when(F.max("toxic") == 1, "SUSPICIOUS").when(F.min("quality") == 1, "VERIFIED")
    dim = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("sha").agg(of.alias("classification"))
    return lookup.with_default(docs, dim, "sha", "classification", "UNKNOWN")


EXACT = {"ECONOMY": "cheap", "PROMO": "offer"}
PREFIX = {"EC": "never", "ST": "standard-like", "S": "s-like"}


@query("""
SELECT p_type, CASE WHEN p_type = 'ECONOMY' THEN 'cheap' WHEN p_type = 'PROMO' THEN 'offer' WHEN starts_with(p_type, 'EC') THEN 'never' WHEN starts_with(p_type, 'ST') THEN 'standard-like' WHEN starts_with(p_type, 'S') THEN 's-like' END AS kind, count(*) AS n FROM part GROUP BY ALL""")
def exact_then_prefix_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type", lookup.exact_else_prefix(F.col("p_type"), EXACT, PREFIX).alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'returned' WHEN l_linestatus = 'O' THEN 'open' END AS grp, count(*) AS n FROM lineitem GROUP BY ALL""")
def exact_then_wildcard_lookup(spark, sf_dir):
    grp = lookup.exact_else_wildcard(F.col("l_returnflag"), F.col("l_linestatus"), {"R#F": "returned", "*#O": "open"})
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", grp.alias("grp")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def missing_reference(spark, sf_dir):
    present = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.missing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), present, "c_custkey")


KNOWN_PARTS = ["smallring", "redwidget", "bluebolt", "greengear", "largegear"]
_SKEL = "translate(replace(replace({x}, 'rn', 'm'), 'vv', 'w'), '013547i', 'olesatl')"


@query(f"""
WITH named AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN translate(p_name, 'lo', '10') WHEN 1 THEN p_name || 's' ELSE p_name END AS name FROM part),
norm AS (SELECT p_partkey, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n FROM named), dim(known) AS (VALUES {", ".join(f"('{k}')" for k in KNOWN_PARTS)}),
near AS (SELECT p_partkey, name, known, CASE WHEN {_SKEL.format(x="known")} = {_SKEL.format(x="n")} THEN 0 ELSE 1 END AS rk, levenshtein({_SKEL.format(x="n")}, {_SKEL.format(x="known")}) AS d, n FROM norm, dim
  WHERE length(n) >= 3 AND n NOT IN (SELECT known FROM dim) AND NOT starts_with(n, known)),
hit AS (SELECT * FROM near WHERE d <= CASE WHEN length(known) < 8 THEN 1 ELSE 2 END)
SELECT p_partkey, name, known, CASE WHEN rk = 0 THEN 'skeleton' ELSE 'distance' END AS kind, CAST(d AS BIGINT) AS distance FROM hit QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rk, d, known) = 1""")
def name_lookalike(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.translate("p_name", "lo", "10")).when(k == 1, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("like", lookup.lookalike(F.col("name"), KNOWN_PARTS))
    return rows.filter("like is not null").select("p_partkey", "name", "like.known", "like.kind", F.col("like.distance").cast("long").alias("distance"))


#: Words of documents and of benchmark, the latter as a table of names, prefixes or fragments.
WORD = "[A-Za-z0-9]+"
WORDS_SQL = f"""
words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS word FROM documents),
dim AS (SELECT word, min(item_id) AS item_id FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM benchmark) GROUP BY word)"""


def _words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).distinct()


def _dim(spark, sf_dir) -> DataFrame:
    """word, item_id: the words of benchmark with the first item that has each."""
    said = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    return said.groupBy("word").agg(F.min("item_id").alias("item_id"))


@query(f"""
WITH {WORDS_SQL},
named AS (SELECT word, lower(word) AS n FROM words WHERE length(word) >= 3), known AS (SELECT word AS known, {_SKEL.format(x="word")} AS ksk FROM dim WHERE length(word) >= 5),
near AS (SELECT word, known, {_SKEL.format(x="n")} AS sk, ksk FROM named JOIN known ON length(n) BETWEEN length(known) - 12 AND length(known) + 12 AND NOT starts_with(n, known) WHERE n NOT IN (SELECT word FROM dim)),
hit AS (SELECT word, known, CASE WHEN sk = ksk THEN 0 ELSE 1 END AS rk, levenshtein(sk, ksk) AS d FROM near WHERE abs(length(sk) - length(ksk)) <= 2)
SELECT word, known, CASE WHEN rk = 0 THEN 'skeleton' ELSE 'distance' END AS kind, CAST(d AS BIGINT) AS distance FROM hit WHERE d <= CASE WHEN length(known) < 8 THEN 1 ELSE 2 END
QUALIFY row_number() OVER (PARTITION BY word ORDER BY rk, d, known) = 1""")
def name_lookalike_table(spark, sf_dir):
    """Words of documents that imitate a word of benchmark: two tables, joined by an index of neighbourhoods."""
    found = dimensions.lookalikes(_words(spark, sf_dir), "word", _dim(spark, sf_dir), "word")
    return found.filter("like is not null").select("word", "like.known", "like.kind", F.col("like.distance").cast("long").alias("distance"))


@query(f"""
WITH {WORDS_SQL},
whole AS (SELECT word AS name, 'item ' || item_id AS value FROM dim WHERE length(word) >= 8),
prefixes AS (SELECT word AS prefix, 'prefix ' || word AS value, item_id FROM dim WHERE length(word) < 8),
fits AS (SELECT word, prefix, value, row_number() OVER (PARTITION BY word ORDER BY item_id, prefix) AS k FROM words JOIN prefixes ON starts_with(word, prefix))
SELECT word, coalesce(whole.value, fits.value) AS value FROM words LEFT JOIN whole ON word = name LEFT JOIN (SELECT * FROM fits WHERE k = 1) fits USING (word)""")
def prefix_table_lookup(spark, sf_dir):
    """Words of documents looked up in two tables: exact names first, then the first prefix by item."""
    dim = _dim(spark, sf_dir)
    whole = dim.filter(F.length("word") >= 8).select(F.col("word").alias("name"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("value"))
    prefixes = dim.filter(F.length("word") < 8).select(F.col("word").alias("prefix"), F.concat(F.lit("prefix "), "word").alias("value"), "item_id")
    return dimensions.with_prefix_of(_words(spark, sf_dir), "word", whole, prefixes, "item_id").select("word", "value")


@query(f"""
WITH {WORDS_SQL}, pattern AS (SELECT string_agg(word, '|' ORDER BY item_id, word) AS p FROM dim WHERE length(word) >= 4),
found AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), (SELECT p FROM pattern))) AS fragment FROM documents)
SELECT fragment, count(*) AS hits, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM found GROUP BY fragment""")
def fragment_table_hits(spark, sf_dir):
    """Fragments of a table found in whole documents from the left, the first in the table's order at each place."""
    listed = fragment_joins.fragment_list(_dim(spark, sf_dir).filter(F.length("word") >= 4), "word", ["item_id", "word"])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    found = fragment_joins.fragments_in(docs, "text", listed).select("doc_id", F.explode("found.place").alias("place"))
    counts = found.groupBy("place").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))
    return counts.join(listed.table, "place").select("fragment", "hits", "docs", "first_doc")


# --- tags -------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS tags FROM events GROUP BY user_id)
SELECT user_id, array_to_string(tags, ',') AS tags FROM t WHERE list_has_any(tags, ['error']) AND list_has_any(tags, ['purchase', 'signup'])""")
def tag_combos(spark, sf_dir):
    tagged = tagging.tags_by_key(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return tagged.filter(tagging.has_all_of_any(F.col("tags"), ["error"], ["purchase", "signup"])).select("user_id", F.array_join("tags", ",").alias("tags"))


@query("""
WITH t AS (SELECT date_trunc('hour', ts) AS h, user_id, list(DISTINCT event_type) AS tags FROM events GROUP BY ALL),
s AS (SELECT h, count(*) FILTER (list_has_any(tags, ['error'])) AS n_first, count(*) FILTER (list_has_any(tags, ['purchase', 'signup'])) AS n_second, count(*) FILTER (list_has_any(tags, ['error']) AND list_has_any(tags, ['purchase', 'signup'])) AS n_both FROM t GROUP BY h)
SELECT CAST(epoch(h) AS BIGINT) AS hour, n_first, n_second FROM s WHERE n_first > 0 AND n_second > 0 AND n_both = 0""")
def combo_spread(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("h"), "user_id", "event_type")
    found = tagging.spread(tagging.tags_by_key(events, ["h", "user_id"], "event_type"), ["h"], ["error"], ["purchase", "signup"])
    return found.select(F.unix_timestamp("h").alias("hour"), "n_first", "n_second")


# --- findings ---------------------------------------------------------------------------------------

_SEV = {"1-URGENT": R.WARNING, "2-HIGH": R.REVIEW}
_SEV_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'WARNING' WHEN '2-HIGH' THEN 'REVIEW' ELSE 'INFO' END"


def _orders(spark, sf_dir) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").withColumn("severity", F.when(p == "1-URGENT", R.WARNING).when(p == "2-HIGH", R.REVIEW).otherwise(R.INFO))


@query(f"""
WITH f AS (SELECT o_custkey, {_SEV_SQL} AS s FROM orders), c AS (SELECT o_custkey, count(*) FILTER (s = 'INFO') AS n_info, count(*) FILTER (s = 'REVIEW') AS n_review, count(*) FILTER (s = 'WARNING') AS n_warning FROM f GROUP BY 1)
SELECT o_custkey, n_info, n_review, n_warning, CASE WHEN n_warning > 0 THEN 'WARNING' WHEN n_review > 0 THEN 'REVIEW' ELSE 'INFO' END AS highest,
  CASE WHEN n_warning > 0 THEN n_warning || ' warnings and ' || n_review || ' items to review' WHEN n_review > 0 THEN n_review || ' items to review' ELSE 'nothing to review' END AS summary FROM c""")
def severity_rollup(spark, sf_dir):
    return reports.severity_rollup(_orders(spark, sf_dir), ["o_custkey"])


@query("""
WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS severity_rank, CASE WHEN l_quantity > 40 THEN 2 ELSE 1 END AS confidence_rank FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, severity_rank, confidence_rank) AS rn, max(severity_rank) OVER (PARTITION BY l_suppkey) AS worst FROM f)
SELECT l_suppkey, l_orderkey, l_linenumber, severity_rank, confidence_rank, rn, FALSE AS is_rest, CAST(0 AS BIGINT) AS n_rest FROM n WHERE rn <= 5
UNION ALL SELECT l_suppkey, NULL, NULL, max(worst), max(confidence_rank), 6, TRUE, count(*) FROM n WHERE rn > 5 GROUP BY l_suppkey""")
def capped_findings(spark, sf_dir):
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.when(flag == "R", 2).when(flag == "A", 1).otherwise(0).alias("severity_rank"), F.when(F.col("l_quantity") > 40, 2).otherwise(1).alias("confidence_rank"))
    return capping.capped(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "severity_rank", "confidence_rank"], 5)


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, n, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY rn) FILTER (rn <= 5) || CASE WHEN n > 5 THEN ' (+' || (n - 5) || ' more)' ELSE '' END AS "where" FROM n GROUP BY o_custkey, n""")
def where_list(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("item"))
    return capping.where_of(rows, ["o_custkey"], ["o_orderkey"], "item")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def first_seen_dedupe(spark, sf_dir):
    return capping.first_seen(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query(f"""
SELECT o_orderkey, severity, row_number() OVER (ORDER BY CASE severity WHEN 'WARNING' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END, o_custkey, o_orderkey) AS place FROM (SELECT *, {_SEV_SQL} AS severity FROM orders)
QUALIFY place <= 100""")
def ordered_report(spark, sf_dir):
    order = [F.desc(reports.severity_rank(F.col("severity"))), "o_custkey", "o_orderkey"]
    top = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "severity").orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("o_orderkey", "severity", "place")


@query("""
WITH c AS (SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS path, CASE WHEN c_acctbal < 0 THEN 'WARNING' WHEN c_acctbal < 500 THEN 'REVIEW' ELSE 'INFO' END AS severity FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT split_part(path, '/', 1) AS root, severity, split_part(path, '/', 2) || ' → ' || split_part(path, '/', 3) || ' → key ' || c_custkey AS location FROM c WHERE severity <> 'INFO'""")
def tree_rollup(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b = F.col("c_acctbal")
    rows = joined.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.when(b < 0, R.WARNING).when(b < 500, R.REVIEW).otherwise(R.INFO).alias("severity"), F.concat(F.lit("key "), F.col("c_custkey").cast("string")).alias("location"))
    return reports.rolled_up(rows, "path").select("root", "severity", "location")


# --- consistency ------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT text, count(DISTINCT source) AS n_values, min(source) AS least, max(source) AS greatest FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY text)
SELECT sha256(text) AS sha, n_values, least, greatest FROM g WHERE n_values > 1""")
def inconsistent_attributes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "source")
    return reports.inconsistent(rows, "sha", "source")


@query("""
WITH d AS (SELECT doc_id AS owner, sha256(text) AS id FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY owner) AS rn, count(*) OVER (PARTITION BY id) AS n_owners FROM d),
g AS (SELECT id, list(owner ORDER BY owner) AS names FROM n WHERE rn <= 6 AND n_owners > 1 GROUP BY id)
SELECT owner, id, n_owners, array_to_string(list_filter(names, lambda x: x <> owner)[1:5], ', ') AS others FROM n JOIN g USING (id) WHERE n_owners > 1""")
def shared_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return reports.shared_ids(rows, "doc_id", "sha")


@query("""
SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS copy, lang FROM documents QUALIFY copy > 1""")
def repeated_names(spark, sf_dir):
    return reports.repeated_names(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), ["source"], "lang", "doc_id")


@query("""
WITH d AS (SELECT doc_id, CAST(n_chars AS BIGINT) * 1000 AS size, CAST(len(list_distinct(string_split(text, ''))) AS BIGINT) * 300 AS packed FROM documents)
SELECT doc_id, size >= 5242880 AS large, size >= 1048576 AND size > 100 * greatest(packed, 1) AS high_ratio FROM d""")
def large_and_ratio(spark, sf_dir):
    kinds = F.size(F.array_distinct(F.filter(F.split("text", ""), lambda c: c != "")))
    rows = table(spark, sf_dir, "documents").select(
        F.lit("a").alias("archive_id"), F.lit("").alias("node_path"), F.col("doc_id").alias("entry_seq"), F.col("doc_id").cast("string").alias("name"), F.lit(False).alias("is_dir"),
        (F.col("n_chars") * 1000).alias("size_bytes"), (kinds * 300).cast("long").alias("compressed_bytes"), F.lit(0).alias("flag_bits"), F.lit("unknown").alias("magic"),
    )
    has = lambda kind: F.array_contains("kinds", kind)
    return rules.inventory(rows).select(F.col("entry_seq").alias("doc_id"), has("large_files").alias("large"), has("compression_ratio").alias("high_ratio"))


@query("""
WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN replace(props, '"k": ', '"k": "x') || '' WHEN 2 THEN '{"k": [1]}' ELSE '{"k": true}' END AS props, regexp_extract(props, '[0-9]+') AS n FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN n END AS k FROM p""")
def json_tolerant(spark, sf_dir):
    k = F.col("event_id") % 4
    props = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.replace("props", F.lit('"k": '), F.lit('"k": "x')))).when(k == 2, '{"k": [1]}').otherwise('{"k": true}')
    v = F.try_parse_json(props)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    value = F.when(kind.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(v, "$.k", "string"))
    return table(spark, sf_dir, "events").select("event_id", value.alias("k"))


# --- archives ---------------------------------------------------------------------------------------


@query(IP_SQL)
def archive_roundtrip(spark, sf_dir):
    """Texts written into class files and archives, decoded again, and searched for addresses: as if searched directly."""
    t = decoded(packed(table(spark, sf_dir, "documents")))
    literals = t.classes.filter("status = 'parsed'").select(F.regexp_extract("name", "^d/(-?[0-9]+)_", 1).cast("long").alias("doc_id"), F.explode("strings").alias("value"))
    return public_addresses(literals)


@query(f"""
WITH urls AS ({URL_ROWS}), hosts AS (SELECT url, lower(url) AS low, {HOST_SQL} AS host FROM urls), v AS (SELECT DISTINCT url, {URL_CASE} AS verdict FROM hosts),
w AS (SELECT url, split_part(verdict, '|', 1) AS severity, split_part(verdict, '|', 2) AS confidence, split_part(verdict, '|', 3) AS label FROM v)
SELECT url, severity, CASE WHEN severity = 'REVIEW' THEN 'LOW' ELSE confidence END AS confidence, 'Address: ' || label AS title FROM w WHERE severity <> 'INFO'""")
def address_findings(spark, sf_dir):
    """Addresses written into archives and graded by all rules: each address with the rating of a class that does not reach the network."""
    t = decoded(packed(_url_rows(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))))
    found = findings_of(t, limits=Limits(max_findings_per_rule=1_000_000), only=["addresses"]).filter("rule_id = 'strings.url'")
    return found.select(F.regexp_extract("location", "^(.*) in d/", 1).alias("url"), "severity", "confidence", "title").distinct()


#: Texts of an archive that is built by id.
GROUP = 16


def _text_archives(spark, sf_dir) -> DataFrame:
    """Archives of documents' whole texts, GROUP neighbours by id in each: as they are, cut in half, no archive at all, or with the first entry's data damaged."""
    g = F.floor(F.col("doc_id") / GROUP)
    rows = table(spark, sf_dir, "documents").select(g.cast("string").alias("archive_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("t/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    files = archives_of(rows)
    c, k = F.col("content"), F.col("archive_id").cast("long") % 4
    # The first header has 30 bytes and the name; 0xFF begins no deflated data.
    at = F.lit(30 + len("t/.txt")) + F.length((F.col("archive_id").cast("long") * GROUP).cast("string"))
    damaged = F.concat(F.substring(c, F.lit(1), at), F.unhex(F.lit("FF")), F.substring(c, at + 2, F.length(c)))
    none = F.encode(F.concat(F.lit("no archive "), "archive_id"), "UTF-8")
    return files.withColumn("content", F.when(k == 1, F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))).when(k == 2, none).when(k == 3, damaged).otherwise(c))


_GROUPS_SQL = f"""
docs AS (SELECT doc_id // {GROUP} AS g, doc_id, strlen(coalesce(text, '')) AS bytes FROM documents),
of_group AS (SELECT g, g % 4 AS k, count(*) AS n, sum(bytes) AS bytes, coalesce(max(bytes) FILTER (doc_id = g * {GROUP}), 0) AS first_bytes FROM docs GROUP BY g)"""


@query(f"""
WITH {_GROUPS_SQL}
SELECT CAST(g AS VARCHAR) AS archive_id, k IN (0, 3) AS valid, CASE WHEN k IN (0, 3) THEN n ELSE 0 END AS entries, CASE WHEN k IN (0, 3) THEN CAST(bytes AS BIGINT) ELSE 0 END AS declared_bytes,
  CASE WHEN k = 0 THEN 0 WHEN k < 3 THEN 1 ELSE CAST(first_bytes >= 4 AS BIGINT) END AS n_errors,
  CASE k WHEN 1 THEN 'not analysed, the file could not be read as an archive: no end record' WHEN 2 THEN 'not analysed, the file could not be read as an archive: not an archive'
    WHEN 3 THEN 'nothing to review' || CASE WHEN first_bytes >= 4 THEN '; 1 entries could not be read' ELSE '' END ELSE 'nothing to review' END AS summary
FROM of_group""")
def refused_archives(spark, sf_dir):
    """Texts packed, broken and triaged: what reports say of files and entries that cannot be read."""
    files = _text_archives(spark, sf_dir)
    t = decoded(files)
    r = file_reports(t.files, findings_of(t, only=["contents"]).filter("severity <> 'INFO'"), t)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return r.select("archive_id", "valid", zero("entries"), zero("declared_bytes"), zero("n_errors"), "summary")


@query(f"""
WITH {_GROUPS_SQL}
SELECT CAST(doc_id // {GROUP} AS VARCHAR) AS archive_id, doc_id - min(doc_id) OVER (PARTITION BY doc_id // {GROUP}) AS entry_seq, 't/' || doc_id || '.txt' AS name, CAST(bytes AS BIGINT) AS size_bytes,
  (doc_id // {GROUP}) % 4 = 3 AND doc_id = (doc_id // {GROUP}) * {GROUP} AND bytes >= 4 AS unread
FROM docs WHERE (doc_id // {GROUP}) % 4 IN (0, 3)""")
def archive_entries_sql(spark, sf_dir):
    """Entries of the archives that can be read, decoded by a table function in SQL."""
    register(spark)
    rows = _text_archives(spark, sf_dir).select("archive_id", "content")
    return spark.sql("SELECT archive_id, entry_seq, name, size_bytes, message IS NOT NULL AS unread FROM {rows}, LATERAL jar_entries(content)", rows=rows)


@query(f"""
WITH docs AS (SELECT doc_id // {GROUP} AS g, doc_id, lang, source FROM documents),
classes AS (SELECT g, doc_id, coalesce(lang, 'x') || '/' || coalesce(source, 'y') AS package, 45 + doc_id % 20 AS major FROM docs),
packages AS (SELECT g, 'package' AS kind, package AS value, count(*) AS n, min(doc_id) AS first FROM classes GROUP BY ALL),
versions AS (SELECT g, 'java_version' AS kind, CASE WHEN major >= 49 THEN 'Java ' || (major - 44) ELSE 'Java 1.' || (major - 44) END AS value, count(*) AS n, min(doc_id) AS first FROM classes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g, kind ORDER BY n DESC, first) AS place FROM (SELECT * FROM packages UNION ALL SELECT * FROM versions))
SELECT CAST(g AS VARCHAR) AS archive_id, kind, value, n, place FROM ranked WHERE place <= 10""")
def archive_histograms(spark, sf_dir):
    """Packages and Java versions of archives whose classes are named after documents: the ten most frequent of each archive."""
    d = table(spark, sf_dir, "documents")
    package = F.concat(F.coalesce("lang", F.lit("x")), F.lit("/"), F.coalesce("source", F.lit("y")))
    name = F.concat(package, F.lit("/D"), F.col("doc_id").cast("string"))
    # A class file with nothing but its name: constants 1 and 2 are the name and the class.
    size = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    raw = F.encode(name, "UTF-8")
    body = F.concat(F.unhex(F.lit("CAFEBABE0000")), size(F.lit(45) + F.col("doc_id") % 20, 4), F.unhex(F.lit("000301")), size(F.length(raw), 4), raw, F.unhex(F.lit("07000100210002")), F.unhex(F.lit("0" * 20)))
    rows = d.select(F.floor(F.col("doc_id") / GROUP).cast("string").alias("archive_id"), F.col("doc_id").alias("seq"), F.concat(name, F.lit(".class")).alias("name"), body.alias("content"))
    t = decoded(archives_of(rows))
    parts = [(inventory.packages(t.classes), "package"), (inventory.java_versions(t.classes), "java_version")]
    firsts = [capping.first_rows(x, ["archive_id"], [F.desc("n"), "first_seq"], 10, "place").select("archive_id", F.lit(kind).alias("kind"), F.col(kind).alias("value"), "n", F.col("place").cast("long").alias("place")) for x, kind in parts]
    return firsts[0].unionByName(firsts[1])


@query("SELECT p_partkey, key, value, position FROM part, LATERAL (VALUES ('Manifest-Version', '1.0', 0), ('Name', p_brand || p_type, 1), ('Main-Class', 'x.' || p_size, 2)) t(key, value, position)")
def manifest_parse(spark, sf_dir):
    lines = F.concat(F.lit("Manifest-Version: 1.0\r\nName: "), "p_brand", F.lit("\r\n "), "p_type", F.lit("\r\nno attribute\r\nName2\r\nMain-Class: y\r\nMain-Class: x."), F.col("p_size").cast("string"), F.lit("\r\n\r\nLater: no\r\n"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("archive_id"), F.lit("").alias("node_path"), F.lit("entry").alias("kind"), F.lit("META-INF/MANIFEST.MF").alias("name"), F.lit(0).alias("entry_seq"), F.encode(lines, "UTF-8").alias("content"))
    return descriptors.manifest(rows).select(F.col("archive_id").alias("p_partkey"), "key", "value", "position")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Fabric' WHEN 1 THEN 'Quilt' ELSE 'Forge (legacy)' END AS loader, p_name AS mod_id, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS version FROM part""")
def descriptor_parse(spark, sf_dir):
    k = F.col("p_partkey") % 3
    body = F.concat(F.lit('{"id": "'), "p_name", F.lit('", "modid": "'), "p_name", F.lit('", "version": '), F.when(k == 2, F.lit("[1]")).otherwise(F.col("p_size").cast("string")), F.lit("}"))
    whole = F.when(k == 0, body).when(k == 1, F.concat(F.lit('{"quilt_loader": '), body, F.lit("}"))).otherwise(F.concat(F.lit('{"modList": ['), F.regexp_replace(body, '"id"', '"other"'), F.lit("]}")))
    name = F.when(k == 0, "fabric.mod.json").when(k == 1, "quilt.mod.json").otherwise("mcmod.info")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("archive_id"), F.lit("").alias("node_path"), F.lit("entry").alias("kind"), name.alias("name"), F.lit(0).alias("entry_seq"), F.encode(whole, "UTF-8").alias("content"))
    return descriptors.mods(rows).select(F.col("archive_id").alias("p_partkey"), "loader", "mod_id", "version")


_ODD = [".qqq", "", ".tar"]
_NAMES = [*R.COMMON_EXTENSIONS, *R.NATIVE_EXTENSIONS, *R.EXECUTABLE_EXTENSIONS, ".jar", *_ODD]
_KINDS_OF_FILE = [*dict.fromkeys(R.MAGIC.values()), "unknown"]
_ALLOWED = " OR ".join(f"(magic = '{m}' AND NOT list_contains([{_quoted(e)}], ext))" for m, e in R.MAGIC_EXTENSIONS.items())


@query(f"""
WITH p AS (SELECT page_id, page_id // 40 AS g, CASE WHEN page_id % 11 = 0 THEN '../' WHEN page_id % 13 = 0 THEN 'a' || chr(8238) ELSE '' END || 'f' || regexp_extract(url, '[^/?#]*$') AS base, page_id % {len(_NAMES)} AS e, page_id % {len(_KINDS_OF_FILE)} AS m, CAST(length(html) AS BIGINT) AS n FROM pages),
e AS (SELECT page_id, g, replace(base, '.', '_') || ([{_quoted(_NAMES)}])[CAST(e + 1 AS INTEGER)] AS name, ([{_quoted(_NAMES)}])[CAST(e + 1 AS INTEGER)] AS ext, ([{_quoted(_KINDS_OF_FILE)}])[CAST(m + 1 AS INTEGER)] AS magic, n * 2000 AS size, n * (1 + page_id % 40) AS packed, page_id % 4 AS flags FROM p),
k AS (SELECT *, regexp_matches(lower(regexp_extract(name, '[^/]*$')), '^({"|".join(R.BARE_NAMES)})') AS bare, {_ALLOWED} AS odd, row_number() OVER (PARTITION BY g, name ORDER BY page_id) > 1 AS again FROM e),
named AS (SELECT page_id, unnest([
  CASE WHEN list_contains([{_quoted(R.NATIVE_EXTENSIONS)}], ext) THEN 'native_libraries' WHEN list_contains([{_quoted(R.EXECUTABLE_EXTENSIONS)}], ext) THEN 'executables' WHEN ext = '.jar' THEN 'nested_jars' WHEN ext = '' AND bare THEN NULL WHEN NOT list_contains([{_quoted(R.COMMON_EXTENSIONS)}], ext) THEN 'unusual_files' END,
  CASE WHEN odd AND magic <> 'ZIP/JAR archive' THEN 'disguised' END, CASE WHEN odd AND magic = 'ZIP/JAR archive' THEN 'hidden_archive' END, CASE WHEN flags % 2 = 1 THEN 'encrypted' END, CASE WHEN again THEN 'duplicates' END,
  CASE WHEN list_contains(string_split(name, '/'), '..') THEN 'unsafe_paths' END, CASE WHEN contains(name, chr(8238)) THEN 'deceptive_names' END,
  CASE WHEN size >= 1048576 AND size > 100 * greatest(packed, 1) THEN 'compression_ratio' END, CASE WHEN size >= 5242880 THEN 'large_files' END]) AS kind FROM k)
SELECT p.page_id, coalesce(string_agg(kind, ',' ORDER BY kind), '') AS kinds FROM pages p LEFT JOIN named n ON n.page_id = p.page_id AND kind IS NOT NULL GROUP BY p.page_id""")
def entry_inventory(spark, sf_dir):
    """Entries named after pages, of every extension and kind of first bytes: what is notable of each."""
    k = F.col("page_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    base = F.concat(F.when(k % 11 == 0, "../").when(k % 13 == 0, "a‮").otherwise(""), F.lit("f"), F.regexp_extract("url", "[^/?#]*$", 0))
    n = F.length("html").cast("long")
    rows = table(spark, sf_dir, "pages").select(
        F.floor(k / 40).cast("string").alias("archive_id"), F.lit("").alias("node_path"), k.alias("entry_seq"), F.concat(F.replace(base, F.lit("."), F.lit("_")), pick(_NAMES)).alias("name"), F.lit(False).alias("is_dir"),
        (n * 2000).alias("size_bytes"), (n * (1 + k % 40)).alias("compressed_bytes"), (k % 4).cast("int").alias("flag_bits"), pick(_KINDS_OF_FILE).alias("magic"),
    )
    return rules.inventory(rows).select(F.col("entry_seq").alias("page_id"), F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


_BOUND = ["com/sun/jna/Native", "net/bytebuddy/Agent", "q/Own"]
_REFS = [*R.API_CLASSES, *[p + "Of" for p in R.API_PACKAGE_PREFIXES], *R.FILE_WRITE_CLASSES, *_BOUND]
_MEMBERS = [m.replace("*#", "q/Own#") for m in R.API_MEMBERS] + R.FILE_WRITE_MEMBERS + R.NATIVE_FILE_LOAD_MEMBERS + [f"{o}Some#{m}" for o in R.SESSION_TOKEN_OWNERS for m in R.SESSION_TOKEN_MEMBERS]
_values = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)


@query(f"""
WITH refs AS (SELECT o_custkey, ([{_quoted(_REFS)}])[CAST(o_orderkey % {len(_REFS)} + 1 AS INTEGER)] AS ref FROM orders), calls AS (SELECT o_custkey, ([{_quoted(_MEMBERS)}])[CAST(o_orderkey // 3 % {len(_MEMBERS)} + 1 AS INTEGER)] AS member FROM orders),
exact(name, grp) AS (VALUES {_values(R.API_CLASSES.items())}), prefixes(prefix, grp) AS (VALUES {_values(R.API_PACKAGE_PREFIXES.items())}), members(name, grp) AS (VALUES {_values(R.API_MEMBERS.items())}),
tags AS (
  SELECT o_custkey, coalesce(e.grp, p.grp) AS tag FROM refs LEFT JOIN exact e ON ref = name LEFT JOIN prefixes p ON starts_with(ref, prefix)
  UNION SELECT o_custkey, coalesce(m.grp, w.grp) FROM calls LEFT JOIN members m ON member = m.name LEFT JOIN members w ON w.name = '*#' || split_part(member, '#', 2)
  UNION SELECT o_custkey, 'file_write' FROM refs WHERE ref IN ({_quoted(R.FILE_WRITE_CLASSES)}) UNION SELECT o_custkey, 'file_write' FROM calls WHERE member IN ({_quoted(R.FILE_WRITE_MEMBERS)})
  UNION SELECT o_custkey, 'native_file_load' FROM calls WHERE member IN ({_quoted(R.NATIVE_FILE_LOAD_MEMBERS)})
  UNION SELECT o_custkey, 'session_token' FROM calls WHERE split_part(member, '#', 2) IN ({_quoted(R.SESSION_TOKEN_MEMBERS)}) AND ({" OR ".join(f"starts_with(member, '{o}')" for o in R.SESSION_TOKEN_OWNERS)})
  UNION SELECT o_custkey, 'bytecode_gen' FROM refs WHERE regexp_matches(ref, '{R.BYTECODE_LIBRARY}'))
SELECT o_custkey, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN tags USING (o_custkey) GROUP BY o_custkey""")
def class_tags(spark, sf_dir):
    """Classes that reference what their customers' orders stand for, over all API names: the tags of each."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    k = F.col("o_orderkey")
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(pick(_REFS, k)).alias("class_refs"), F.collect_set(pick(_MEMBERS, F.floor(k / 3))).alias("member_refs"))
    rows = held.select(
        F.col("o_custkey").alias("archive_id"), F.lit("").alias("node_path"), F.lit(0).alias("entry_seq"), F.lit("A.class").alias("entry_name"), F.lit("parsed").alias("status"), F.lit("A").alias("name"),
        F.lit("java/lang/Object").alias("super_name"), F.lit(61).alias("major_version"), "class_refs", "member_refs", F.array().cast("array<string>").alias("strings"),
    )
    return class_evidence(rows).select(F.col("archive_id").alias("o_custkey"), F.array_join("tags", ",").alias("tags"))


_FOUND = f"""
urls AS ({URL_ROWS}), hosts AS (SELECT page_id, url, lower(url) AS low, {HOST_SQL} AS host FROM urls), rated AS (SELECT page_id, url, split_part({URL_CASE}, '|', 1) AS severity FROM hosts)"""


def _literal_archives(spark, sf_dir) -> DataFrame:
    """FILES: classes of 20 pages an archive; a class holds its page's address, plain or encoded, and every third reaches the network and reads the session token."""
    k = F.col("page_id")
    coded = F.base64(F.concat(F.lit("look at "), "url", F.lit(" and stay there until all of it is done")).cast("binary"))
    hidden = F.rtrim(F.translate(coded, "\r\n", ""), F.lit("="))  # the session may break such text into lines
    text = F.when(k % 5 == 0, hidden).otherwise(F.col("url"))
    rows = _url_rows(spark, sf_dir).select(F.floor(k / 20).cast("string").alias("archive_id"), k.alias("seq"), F.concat(F.lit("p/C"), k.cast("string")).alias("name"), text.alias("text"), (k % 3 == 0).alias("calls"))
    size = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    utf8 = lambda c: F.concat(F.unhex(F.lit("01")), size(F.octet_length(c), 4), F.encode(c, "UTF-8"))
    member = lambda at, owner, name: F.concat(utf8(F.lit(owner)), F.unhex(F.lit(f"07{at:04x}")), utf8(F.lit(name)), utf8(F.lit("()V")), F.unhex(F.lit(f"0c{at + 2:04x}{at + 3:04x}0a{at + 1:04x}{at + 4:04x}")))
    pool = F.concat(utf8(F.col("name")), F.unhex(F.lit("070001")), utf8(F.col("text")), F.unhex(F.lit("080003")))
    calls = F.concat(member(5, "java/net/URL", "openStream"), member(11, "net/minecraft/Session", "getAccessToken"))
    body = F.concat(F.unhex(F.lit("CAFEBABE0000003D")), F.unhex(F.when(F.col("calls"), "0011").otherwise("0005")), pool, F.when(F.col("calls"), calls).otherwise(F.unhex(F.lit(""))), F.unhex(F.lit("002100020000" + "0" * 16)))
    return archives_of(rows.select("archive_id", "seq", F.concat("name", F.lit(".class")).alias("name"), body.alias("content")))


_SHOWN = "string_agg(place, ', ' ORDER BY page_id) FILTER (k <= 5) || CASE WHEN max(k) > 5 THEN ' (+' || (max(k) - 5) || ' more)' ELSE '' END"


@query(f"""
WITH {_FOUND},
firsts AS (SELECT *, page_id // 20 AS g, row_number() OVER (PARTITION BY page_id // 20, url ORDER BY page_id) = 1 AS first FROM rated),
token AS (SELECT page_id // 20 AS g, page_id, 'p/C' || page_id || '.class' AS place, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) AS k FROM pages WHERE page_id % 3 = 0),
hidden AS (SELECT page_id // 20 AS g, page_id, severity, 'p/C' || page_id || '.class: ' || url AS place, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) AS k FROM rated WHERE page_id % 5 = 0),
bad AS (SELECT g, bool_or(page_id % 3 = 0) AS near FROM firsts WHERE first AND severity <> 'INFO' GROUP BY g)
SELECT CAST(t.g AS VARCHAR) AS archive_id, 'combo.session_token_network' AS rule_id, CASE WHEN any_value(b.g) IS NOT NULL THEN 'WARNING' ELSE 'REVIEW' END AS severity, CASE WHEN bool_or(near) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, {_SHOWN} AS location FROM token t LEFT JOIN bad b USING (g) GROUP BY t.g
UNION ALL SELECT CAST(g AS VARCHAR), 'strings.encoded_url', 'REVIEW', CASE WHEN bool_or(severity <> 'INFO' OR page_id % 3 = 0) THEN 'MEDIUM' ELSE 'LOW' END, {_SHOWN} FROM hidden GROUP BY g""")
def archive_findings(spark, sf_dir):
    """Pages' addresses written into classes, plain and encoded: the findings that speak of a whole archive, with the places of all its classes."""
    t = decoded(_literal_archives(spark, sf_dir))
    found = findings_of(t, only=["archives"]).filter("rule_id in ('combo.session_token_network', 'strings.encoded_url')")
    return found.select("archive_id", "rule_id", "severity", "confidence", "location")


@query(f"""
WITH {_FOUND}
SELECT page_id // 20 AS archive, page_id, 'url' AS kind, url AS item, page_id % 5 = 0 AS decoded, 'p/C' || page_id || '.class' || CASE WHEN page_id % 5 = 0 THEN ' (Base64-decoded string)' ELSE '' END AS place FROM rated""")
def literal_places(spark, sf_dir):
    """Where each address stands: in a class as it is, or within an encoded literal."""
    t = decoded(_literal_archives(spark, sf_dir))
    facts = literal_facts(class_evidence(t.classes)).filter("kind = 'url'")
    return facts.select(F.col("archive_id").cast("long").alias("archive"), F.col("entry_seq"), F.regexp_extract("entry_name", "C([0-9]+)", 1).cast("long").alias("page_id"), "kind", "item", "decoded", F.col("where").alias("place")).drop("entry_seq")


@query("SELECT CASE WHEN p_size + 30 >= 49 THEN 'Java ' || (p_size + 30 - 44) ELSE 'Java 1.' || (p_size + 30 - 44) END AS version, count(*) AS n FROM part GROUP BY 1")
def class_versions(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(T.java_version_label(F.col("p_size") + 30).alias("version")).agg(F.count("*").alias("n"))


@query(r"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cmd.exe' WHEN 1 THEN '/bin/sh' WHEN 2 THEN 'curl' ELSE lower(regexp_extract(p_type, '\S+')) END AS command FROM part""")
def command_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    token = F.when(k == 0, ' "C:\\Tools\\CMD.EXE" /c dir').when(k == 1, "'/bin/sh' -c ls").when(k == 2, "/usr/bin/curl http://example.com/x/y").otherwise(F.concat(F.lit("dir/"), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", T.command_name(T.first_word(token), R.SHELL_COMMANDS).alias("command"))
