"""Graded findings from evidence.

Each family is one plan: rows of its subject (node, entry, class, project) carry an array of the findings
whose conditions hold, which one `inline` turns into rows. So all class rules share one pass over the
classes and all node rules one pass over the aggregated nodes, however many rules there are.
INFO is always of LOW confidence. Findings are evidence for a reader, not verdicts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline import refdata as R
from sieveline.functions import text as T
from sieveline.functions import urls as U
from sieveline.limits import Limits
from sieveline.operators.capping import capped, first_rows, where_list, where_of
from sieveline.operators.lookup import lookalike
from sieveline.operators.reports import confidence_rank, name_of, severity_rank, shared_ids
from sieveline.operators.tagging import has_all_of_any, has_any
from sieveline.plans.evidence import FRAGMENTS, class_evidence, literal_facts
from sieveline.plans.job import Cancelled
from sieveline.plans.explanations import RATIONALES, explanation_of
from sieveline.refdata import HIGH, INFO, LOW, MEDIUM, REVIEW, WARNING

NODE = ["archive_id", "node_path"]
#: Order of rule families in reports.
FAMILIES = ["hash", "metadata", "manifest", "contents", "classes", "api", "combo", "strings", "batch"]


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _finding(rule: str, when: Column, severity, title, where=None, confidence=LOW, context="") -> Column:
    """A finding where `when` holds, else null."""
    severity = _c(severity)
    place = F.lit("(archive)") if where is None else where
    return F.when(F.coalesce(when, F.lit(False)), F.struct(
        F.lit(rule).alias("rule_id"), severity.alias("severity"), F.when(severity == INFO, LOW).otherwise(_c(confidence)).alias("confidence"),
        T.safe_text(_c(title), 300).alias("title"), T.safe_text(place, 2000).alias("location"), T.safe_text(_c(context), 2000).alias("context"),
    ))


def _reasons() -> dict[str, Column]:
    """explanation of the rule, and rationale of the rating that severity and confidence give."""
    rating = F.create_map(*[F.lit(x) for pair in RATIONALES.items() for x in pair])
    return {"explanation": explanation_of(F.col("rule_id")), "rationale": rating[F.concat_ws("/", "severity", "confidence")]}


def _emit(rows: DataFrame, keys: list[str], found: list[Column], seq: Column | None = None) -> DataFrame:
    held = rows.select(*keys, (F.lit(0).cast("long") if seq is None else seq.cast("long")).alias("seq"), F.array_compact(F.array(*found)).alias("found"))
    return held.select(*keys, "seq", F.inline("found"))


def _tags(*wanted: str) -> Column:
    return has_any(F.col("tags"), list(wanted))


def _list(items: Column, shown: int = 5) -> Column:
    return where_list(items, F.size(items), shown)


#: Different addresses of a node that are looked at, in the order in which they are met.
MAX_URLS = 2000


def first_addresses(evidence: DataFrame) -> DataFrame:
    """Each address once a node, where it is first seen: entry_seq, place, where, tags of that class, and u with its rating. Addresses are rated once, however many classes name them."""
    urls = literal_facts(evidence).filter("kind = 'url'")
    first = urls.groupBy(*NODE, F.col("item").alias("url")).agg(F.min_by(F.struct("entry_seq", "place", "where", "tags"), F.struct("entry_seq", "place")).alias("r")).select(*NODE, "url", "r.*")
    first = first_rows(first, NODE, ["entry_seq", "place"], MAX_URLS).drop("rn")
    return first.withColumn("u", F.struct("url", U.classify_url(F.col("url")).alias("v")))


def class_rules(evidence: DataFrame) -> DataFrame:
    """Findings on single classes: processes, downloads, combinations."""
    rows = evidence.withColumn("loc", F.col("entry_name"))
    loc, tags = F.col("loc"), F.col("tags")
    executes = has_any(tags, R.EXECUTION_TAGS)
    shells = F.size("shells") > 0
    shown = F.concat("helpers", "shells", "risky", "programs")
    helpers_only = (F.size("helpers") > 0) & (F.size(shown) == F.size("helpers")) & (F.size("flags") == 0)
    said = lambda what, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{what}: "), F.array_join(names, ", ")))
    ran = F.concat_ws("; ", said("helpers", "helpers"), said("shells", "shells"), said("often abused", "risky"), said("other programs", "programs"), said("out of sight", "flags"))
    ran = F.when(ran == "", "no command is visible").otherwise(ran)
    suspicious = F.exists(F.concat("rated_urls", "rated_hidden"), lambda u: u["v"]["severity"] != INFO)
    strong = _tags("exec_content", "hidden_exec", "shell", "base64", "crypto", "encoded_payload", "encoded_url") | shells | suspicious
    downloader = has_all_of_any(tags, ["network"], R.EXECUTION_TAGS)
    mild = downloader & helpers_only & ~strong & ~_tags("dynamic_loading", "native_file_load")
    context = F.concat(F.lit("also: "), F.array_join(tags, ", "))
    found = [
        _finding("api.process_execution", _tags("process_execution"), REVIEW, F.concat(F.lit("Starts other programs ("), F.when(F.size(shown) > 0, F.array_join(F.slice(shown, 1, 3), ", ")).otherwise("command not visible"), F.lit(")")), loc, F.when(helpers_only, LOW).otherwise(MEDIUM), F.concat(ran, F.lit("; also: "), F.array_join(F.array_except(tags, F.array(F.lit("process_execution"))), ", "))),
        _finding("api.downloads", has_all_of_any(tags, ["network"], ["file_write"]) & ~executes, REVIEW, "Downloads to disk", loc, F.when(_tags("exec_content"), MEDIUM).otherwise(LOW), context),
        _finding("combo.downloader", downloader, F.when(mild, REVIEW).otherwise(WARNING), "Network access next to running code", loc, F.when(mild, MEDIUM).when(strong, HIGH).otherwise(MEDIUM), context),
        _finding("combo.hidden_execution", has_all_of_any(tags, ["process_execution"], ["hidden_exec"]), WARNING, "Starts programs out of sight", loc, F.when(_tags("network", "file_write", "base64", "encoded_payload", "encoded_url"), HIGH).otherwise(MEDIUM), context),
        _finding("combo.persistence_exec", has_all_of_any(tags, ["persistence"], ["process_execution"]), WARNING, "Starts programs and names start-up places", loc, HIGH, context),
        _finding("combo.decoded_exec", has_all_of_any(tags, ["base64", "crypto", "encoded_payload", "encoded_url"], R.EXECUTION_TAGS) & ~downloader, WARNING, "Decodes data next to running code", loc, F.when(_tags("encoded_payload", "encoded_url"), HIGH).otherwise(MEDIUM), context),
    ]
    return _emit(rows, NODE, found, F.col("entry_seq"))


def address_rules(evidence: DataFrame) -> DataFrame:
    """Findings on addresses, each once a node where it is first seen; harmless ones in one list."""
    first = first_addresses(evidence)
    graded = first.filter(F.col("u.v.severity") != INFO)
    weak = (F.col("u.v.severity") == REVIEW) & ~_tags("network")
    listed = _emit(graded, NODE, [_finding("strings.url", F.lit(True), F.col("u.v.severity"), F.concat(F.lit("Address: "), F.col("u.v.label")), F.concat(F.col("url"), F.lit(" in "), F.col("where")), F.when(weak, LOW).otherwise(F.col("u.v.confidence")))], F.col("entry_seq"))
    plain = where_of(first.filter(F.col("u.v.severity") == INFO), NODE, ["entry_seq", "place"], "url", 10)
    others = _emit(plain, NODE, [_finding("strings.urls_other", F.lit(True), INFO, F.concat(F.col("n").cast("string"), F.lit(" other addresses")), F.col("where"))])
    return listed.unionByName(others)


#: Hits of a kind that a node's lists count at most.
MAX_HITS = 200


def _fact_lists(evidence: DataFrame) -> DataFrame:
    """Facts for the lists of a node: tag, shown, and what makes one of its own (empty where equal ones count once)."""
    f = literal_facts(evidence)
    kind, item, where = F.col("kind"), F.col("item"), F.col("where")
    public = ~U.is_private_ipv4(U.ipv4_number(F.substring_index("item", ":", 1)))
    category = F.create_map(*[F.lit(x) for f_, c in FRAGMENTS.items() for x in (f_, f"={c}")])
    each = F.concat_ws(":", "entry_seq", "place")
    said = F.concat(item, F.lit(" in "), where)
    # An address with a port counts where it is first seen: its place is no part of what tells it apart.
    first = f.filter((kind == "ip") & public).groupBy(*NODE, "item").agg(F.min_by(F.struct("entry_seq", "place", "where"), F.struct("entry_seq", "place")).alias("r"))
    ips = first.select(*NODE, "r.entry_seq", "r.place", F.lit("=ip").alias("tag"), F.concat("item", F.lit(" in "), "r.where").alias("shown"), F.lit("").alias("one"))
    tag = F.when(kind == "fragment", category[item]).when((kind == "url") & F.col("decoded"), "=hidden_url").otherwise(F.concat(F.lit("="), kind))
    shown = F.when(kind == "fragment", F.concat(F.lit("'"), item, F.lit("' in "), where)).when(kind == "url", F.concat("entry_name", F.lit(": "), item)).when(kind == "encoded", F.concat(where, F.lit(": "), item)).when(kind == "payload", F.concat(item, F.lit(" in "), "entry_name")).otherwise(said)
    listed = f.filter((kind != "ip") & ((kind != "url") | F.col("decoded")))
    return listed.select(*NODE, "entry_seq", "place", tag.alias("tag"), shown.alias("shown"), F.when(kind == "fragment", "").otherwise(each).alias("one")).unionByName(ips)


def suspicious_addresses(evidence: DataFrame) -> DataFrame:
    """By node: any_url, any_token_url, and lists of the addresses that are not harmless: near_urls (first seen in a class that reads the session token and reaches the network) and other_urls (all)."""
    bad = first_addresses(evidence).filter(F.col("u.v.severity") != INFO)
    near = has_all_of_any(F.col("tags"), ["session_token"], ["network"])
    of = lambda rows, name: where_of(rows, NODE, ["entry_seq", "place"], "url", 3).select(*NODE, F.col("where").alias(name))
    return of(bad, "other_urls").join(of(bad.filter(near), "near_urls"), NODE, "left").withColumns({"any_url": F.lit(True), "any_token_url": F.col("near_urls").isNotNull()})


def jar_evidence(evidence: DataFrame) -> DataFrame:
    """Classes' evidence by node: tags with their class counts and whether tags meet in one class."""
    tags = F.col("tags")
    addresses = F.concat("rated_urls", "rated_hidden")
    warning = F.exists(addresses, lambda u: u["v"]["severity"] == WARNING)
    token = has_all_of_any(tags, ["session_token"], ["network"])
    ip = F.exists("ip_ports", lambda x: ~U.is_private_ipv4(U.ipv4_number(F.substring_index(x, ":", 1))))
    # The first places of each tag; a class that occurs twice counts once. Lists of what literals hold stand under keys that begin with =.
    of_class = lambda key, when: F.when(when, F.array(F.struct(_c(key).alias("tag"), F.col("entry_name").alias("shown")))).otherwise(F.array().cast("array<struct<tag:string,shown:string>>"))
    items = F.concat(F.transform(tags, lambda t: F.struct(t.alias("tag"), F.col("entry_name").alias("shown"))), of_class("=token", token), F.flatten(F.transform("categories", lambda c: F.concat(of_class(F.concat(F.lit("=in "), c), F.lit(True)), of_class(F.concat(F.lit("=runs "), c), has_any(tags, R.EXECUTION_TAGS)), of_class(F.concat(F.lit("=net "), c), has_any(tags, ["network"]))))))
    classes = evidence.select(*NODE, "entry_seq", F.lit(0).alias("place"), F.explode(items).alias("i")).select(*NODE, "entry_seq", "place", "i.tag", "i.shown", F.lit("").alias("one"))
    named = classes.unionByName(_fact_lists(evidence)).groupBy(*NODE, "tag", "shown", "one").agg(F.min(F.struct("entry_seq", "place")).alias("first"))
    by_tag = where_of(named.select(*NODE, "tag", "first.entry_seq", "first.place", "shown"), [*NODE, "tag"], ["entry_seq", "place", "shown"], "shown")
    by_tag = by_tag.select(*NODE, "tag", F.when(F.col("tag").startswith("="), F.least("n", F.lit(MAX_HITS))).otherwise(F.col("n")).alias("n"), F.col("where").alias("example"))
    near = suspicious_addresses(evidence)
    maps = by_tag.groupBy(*NODE).agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("n", "example")))).alias("by_tag"))
    kept = ~F.col("name").rlike("(package|module)-info$")
    loads = has_all_of_any(tags, ["native_loading"], ["native_file_load"])
    external = has_any(tags, R.EXTERNAL_SOURCE_TAGS)
    pair = lambda a, b: F.bool_or(has_all_of_any(tags, a, b))
    sums = evidence.groupBy(*NODE).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("jar_tags"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"),
        F.bool_or(warning).alias("warning_url"), pair(["network"], R.EXECUTION_TAGS).alias("any_downloader"),
        pair(["sensitive_high"], ["network"]).alias("theft_meets"), pair(["encoded_payload"], ["dynamic_loading", "base64"]).alias("payload_meets"),
        F.bool_or((F.size("targets") > 0)).alias("has_target"), F.bool_or((F.size("targets") > 0) & has_any(tags, ["reflection"])).alias("target_meets"),
        F.bool_or(ip).alias("has_ip"), F.bool_or(ip & has_any(tags, ["network"])).alias("ip_meets"), F.sum(F.size("encoded")).alias("n_encoded"),
        F.bool_or((F.size("encoded") > 0) & has_any(tags, R.EXECUTION_TAGS)).alias("encoded_meets"), F.bool_or(F.size("cheats") > 0).alias("has_cheat"),
        F.bool_or(F.exists("rated_hidden", lambda u: u["v"]["severity"] != INFO)).alias("hidden_suspicious"), F.bool_or((F.size("hidden_urls") > 0) & has_any(tags, ["network"])).alias("hidden_meets"),
        F.bool_or(has_all_of_any(tags, ["dynamic_loading"], R.EXTERNAL_SOURCE_TAGS)).alias("load_external"), F.count_if(has_all_of_any(tags, ["dynamic_loading"], R.EXTERNAL_SOURCE_TAGS)).alias("n_load_external"),
        F.count_if(has_any(tags, ["dynamic_loading"]) & ~external & has_any(tags, ["bytecode_gen"])).alias("n_load_generated"), F.count_if(has_any(tags, ["dynamic_loading"]) & ~external & ~has_any(tags, ["bytecode_gen"])).alias("n_load_plain"),
        F.bool_or(loads & external).alias("native_external"), F.bool_or(loads & ~external).alias("native_own"),
        F.count_if(has_any(tags, ["native_loading"]) & ~has_any(tags, ["native_file_load"])).alias("n_bound"), F.count_if(loads & external).alias("n_external"), F.count_if(loads & ~external).alias("n_own"),
        F.count_if(kept).alias("n"), F.count_if(kept & (F.length(T.simple_name(F.col("name"))) <= 2)).alias("n_short"),
    )
    return sums.withColumnRenamed("jar_tags", "tags").join(maps, NODE, "left").join(near, NODE, "left")


#: Rules on one API group alone: severity, confidence, title.
API_RULES = {
    "reflection": (INFO, LOW, "Reflection"), "network": (INFO, LOW, "Network access"), "instrumentation": (REVIEW, MEDIUM, "Instrumentation of classes"), "jndi": (REVIEW, MEDIUM, "Directory lookups"),
    "screen_capture": (REVIEW, MEDIUM, "Screen capture"), "clipboard": (REVIEW, LOW, "System clipboard"), "crypto": (INFO, LOW, "Ciphers"), "unsafe": (INFO, LOW, "Raw memory access"), "session_token": (REVIEW, LOW, "Reads the session token"),
}


def jar_rules(jars: DataFrame, entries_of: DataFrame) -> DataFrame:
    """Findings on a node's classes as a whole. entries_of has the node's inventory (bundled)."""
    tags, own = F.col("tags"), F.col("by_tag")
    n = lambda tag: own[tag]["n"]
    found = [_finding(f"api.{g}", n(g) > 0, s, F.concat(F.lit(f"{title}: "), n(g).cast("string"), F.lit(" classes")), own[g]["example"], c) for g, (s, c, title) in API_RULES.items()]
    ratio = F.col("n_short") / F.col("n")
    native_known = F.coalesce(F.col("bundled_native"), F.lit(False))
    part = lambda n, what: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {what}")))
    native = F.concat_ws("; ", part("n_bound", "only call the system through bindings"), part("n_own", "load library files"), part("n_external", "load library files next to network, decoding or decryption"), F.when(native_known, "the archive has libraries of its own"))
    loading = F.concat_ws("; ", part("n_load_external", "next to network, decoding or decryption"), part("n_load_generated", "next to code that is written at run time"), part("n_load_plain", "from what the archive itself has"))
    risky = F.filter("categories", lambda c: c.isin(R.HIGH_RISK_CATEGORIES))
    found += [
        _finding("api.reflective_sensitive", F.col("has_target"), REVIEW, "Powerful class named in a literal", own["=target"]["example"], F.when(F.col("target_meets"), MEDIUM).otherwise(LOW)),
        _finding("api.native_loading", n("native_loading") > 0, REVIEW, "Native code", own["native_loading"]["example"], F.when(F.col("native_external") | (F.col("native_own") & ~native_known), MEDIUM).otherwise(LOW), native),
        _finding("api.dynamic_loading", n("dynamic_loading") > 0, REVIEW, "Classes loaded at run time", own["dynamic_loading"]["example"], F.when(F.col("load_external"), MEDIUM).otherwise(LOW), loading),
        _finding("combo.downloader_spread", ~F.col("any_downloader") & has_all_of_any(tags, ["network"], ["dynamic_loading", "process_execution"]), REVIEW, "Network access and running code in different classes", None, LOW),
        _finding("combo.data_theft", _tags("sensitive_high") & (_tags("network") | F.col("warning_url")), WARNING, "Private data next to network access", own["sensitive_high"]["example"], F.when(F.col("theft_meets"), HIGH).otherwise(MEDIUM)),
        _finding("combo.packed_payload", has_all_of_any(tags, ["encoded_payload"], ["dynamic_loading", "base64"]), WARNING, "Encoded program that can be loaded", own["encoded_payload"]["example"], F.when(F.col("payload_meets"), HIGH).otherwise(MEDIUM)),
        _finding("combo.session_token_network", n("=token") > 0, F.when(F.col("any_url"), WARNING).otherwise(REVIEW), "Session token next to network access", own["=token"]["example"], F.when(F.col("any_token_url"), HIGH).otherwise(MEDIUM),
                 F.when(F.col("any_token_url"), F.concat(F.lit("suspicious addresses in the same class: "), F.col("near_urls"))).when(F.col("any_url"), F.concat(F.lit("suspicious addresses elsewhere: "), F.col("other_urls"))).otherwise("no suspicious address was found")),
        _finding("strings.encoded_executable", n("=payload") > 0, WARNING, "Encoded program", own["=payload"]["example"], F.when(F.col("payload_meets"), HIGH).otherwise(MEDIUM), F.when(F.col("payload_meets"), "the same class decodes or loads").otherwise("nothing in the same class decodes or loads")),
        _finding("strings.encoded_url", n("=hidden_url") > 0, REVIEW, F.concat(F.lit("Addresses inside encoded literals: "), n("=hidden_url").cast("string")), own["=hidden_url"]["example"], F.when(F.col("hidden_suspicious") | F.col("hidden_meets"), MEDIUM).otherwise(LOW),
                 F.concat_ws("; ", F.when(F.col("hidden_suspicious"), "among them suspicious ones"), F.when(F.col("hidden_meets"), "the same class reaches the network").otherwise("nothing in the same class reaches the network"))),
        _finding("strings.ip_port", F.col("has_ip"), REVIEW, "Address with a port", own["=ip"]["example"], F.when(F.col("ip_meets"), MEDIUM).otherwise(LOW)),
        _finding("strings.encoded", F.col("n_encoded") > 0, F.when((F.col("n_encoded") >= 10) & F.col("encoded_meets"), REVIEW).otherwise(INFO), F.concat(F.col("n_encoded").cast("string"), F.lit(" encoded-looking literals")), own["=encoded"]["example"]),
        _finding("classes.cheat_feature_strings", F.col("has_cheat"), REVIEW, "Literals name unfair game features", own["=cheat"]["example"], LOW),
        _finding("classes.obfuscated", (F.col("n") >= 10) & (ratio >= 0.5), REVIEW, "Most class names are one or two letters", None, MEDIUM),
        _finding("classes.partly_obfuscated", ~((F.col("n") >= 10) & (ratio >= 0.5)) & (ratio >= 0.2) & (F.col("n_short") >= 10), INFO, "Many class names are one or two letters"),
    ]
    for category in R.SENSITIVE:
        graded = WARNING if category in R.HIGH_RISK_CATEGORIES else REVIEW
        of = lambda key: F.when(n(f"={key} {category}") > 0, F.concat(n(f"={key} {category}").cast("string"), F.lit(f" {'run code' if key == 'runs' else 'reach the network'}: "), own[f"={key} {category}"]["example"]))  # noqa: B023, E731
        context = F.concat_ws("; ", F.concat(n(f"=in {category}").cast("string"), F.lit(" classes")), of("runs"), of("net"))
        found.append(_finding("strings.sensitive", F.array_contains("categories", category), graded, category, own[f"={category}"]["example"], LOW if category == R.SHELL_CATEGORY else MEDIUM, context))
    return _emit(jars.join(entries_of, NODE, "left").withColumn("risky", risky), NODE, found)


def class_name_rules(classes: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings on names, gathered to one finding a rule and node with its first places."""
    name, simple = F.col("name"), T.simple_name(F.col("name"))
    client = F.lit(None).cast("string")
    for who, prefix in R.KNOWN_CLIENTS.items():
        client = F.when(name.startswith(prefix), who).otherwise(client)
    path = F.regexp_replace("entry_name", r"^META-INF/versions/\d+/", "")
    mark = lambda rule, when: F.when(when, F.lit(rule))
    marks = F.array_compact(F.array(
        mark("classes.name_mismatch", path != F.concat(name, F.lit(".class"))), mark("classes.confusable_names", simple.rlike(r"^([Il1|]{4,}|[O0]{4,})$")), mark("classes.non_ascii_names", name.rlike(r"[^\x00-\x7F]")),
        mark("classes.default_package", ~F.contains(name, F.lit("/"))), mark("classes.reserved_namespace", name.rlike("^(" + "|".join(R.RESERVED_PACKAGES) + ")")),
        mark("classes.cheat_feature_names", F.lower(simple).rlike("|".join(R.CHEAT_WORDS))), F.when(client.isNotNull(), F.concat(F.lit("classes.known_client|"), client)),
    ))
    # Descriptions of packages and modules are no classes in what their names say.
    info = name.rlike("(package|module)-info$")
    marks = F.when(info, F.filter(marks, lambda m: m == "classes.name_mismatch")).otherwise(marks)
    of_class = classes.filter("status = 'parsed'").select(*NODE, "entry_seq", F.col("name").alias("item"), F.explode(marks).alias("mark"))
    bad = F.lower(T.base_name(F.col("name"))).rlike("|".join(R.MALWARE_WORDS))
    of_entry = entries.filter(~F.col("is_dir") & bad).select(*NODE, "entry_seq", F.col("name").alias("item"), F.lit("classes.malware_names").alias("mark"))
    rows = of_class.unionByName(of_entry)
    first = where_of(rows, [*NODE, "mark"], ["entry_seq", "item"], "item", sums={"webhook": F.min(F.contains(F.lower("item"), F.lit("webhook")))})
    rule = F.substring_index("mark", "|", 1)
    low = rule.isin("classes.default_package", "classes.reserved_namespace") | ((rule == "classes.malware_names") & F.col("webhook"))
    titles = {
        "classes.name_mismatch": "Class names that differ from their paths", "classes.confusable_names": "Class names of look-alike signs", "classes.non_ascii_names": "Class names with other letters", "classes.default_package": "Classes without a package",
        "classes.reserved_namespace": "Classes in a reserved package", "classes.cheat_feature_names": "Class names of unfair game features", "classes.known_client": "Known utility client", "classes.malware_names": "Names that malware uses",
    }
    title = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])[rule]
    title = F.concat_ws(": ", title, F.when(F.contains("mark", F.lit("|")), F.substring_index("mark", "|", -1)))
    one = first.select(*NODE, F.lit(0).cast("long").alias("seq"), rule.alias("rule_id"), F.lit(REVIEW).alias("severity"), F.when(low, LOW).otherwise(MEDIUM).alias("confidence"), title.alias("title"), T.safe_text(F.col("where"), 2000).alias("location"), F.lit("").alias("context"))
    parsing = classes.groupBy(*NODE).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    counts = _emit(parsing, NODE, [
        _finding("classes.invalid", F.col("failed") > 0, REVIEW, F.concat(F.col("failed").cast("string"), F.lit(" classes cannot be parsed")), None, MEDIUM),
        _finding("classes.incomplete", F.col("skipped") > 0, REVIEW, F.concat(F.col("skipped").cast("string"), F.lit(" classes were not read")), None, MEDIUM),
    ])
    return one.unionByName(counts)


def inventory(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Entries with what is notable of each: kinds, an array of names."""
    ext = T.extension_of(F.col("name"))
    allowed = F.lit(None).cast("array<string>")
    for magic, extensions in R.MAGIC_EXTENSIONS.items():
        allowed = F.when(F.col("magic") == magic, F.array(*map(F.lit, extensions))).otherwise(allowed)
    copy = F.row_number().over(Window.partitionBy(*NODE, "name").orderBy("entry_seq"))
    disguised = allowed.isNotNull() & ~F.array_contains(allowed, ext) & ~F.col("is_dir")
    bare = F.lower(T.base_name(F.col("name"))).rlike("^(" + "|".join(R.BARE_NAMES) + ")") | F.col("name").startswith("META-INF/")
    kind = F.when(ext.isin(R.NATIVE_EXTENSIONS), "native_libraries").when(ext.isin(R.EXECUTABLE_EXTENSIONS), "executables").when(ext == ".jar", "nested_jars").when((ext == "") & bare, None).when(~ext.isin(R.COMMON_EXTENSIONS), "unusual_files")
    note = lambda name, when: F.when(when, F.lit(name))
    zip_ = F.col("magic") == "ZIP/JAR archive"
    kinds = F.array_compact(F.array(
        F.when(~F.col("is_dir"), kind), note("disguised", disguised & ~zip_), note("hidden_archive", disguised & zip_), note("encrypted", F.col("flag_bits").bitwiseAND(F.lit(1)) == 1),
        note("duplicates", copy > 1), note("unsafe_paths", T.is_unsafe_path(F.col("name"))), note("deceptive_names", T.has_deceptive_chars(F.col("name"))),
        note("compression_ratio", (F.col("size_bytes") >= limits.suspicious_ratio_min_size) & (F.col("size_bytes") / F.greatest("compressed_bytes", F.lit(1)) > limits.suspicious_ratio)),
        note("large_files", F.col("size_bytes") >= limits.large_file), note("signed", F.col("name").rlike(r"(?i)^META-INF/[^/]+\.(SF|RSA|DSA|EC)$")),
    ))
    return entries.withColumns({"extension": F.when(ext == "", "(none)").otherwise(ext), "kinds": kinds})


CONTENT_RULES = {
    "executables": (REVIEW, MEDIUM, "Programs or scripts"), "native_libraries": (INFO, LOW, "Native libraries"), "disguised": (WARNING, MEDIUM, "Programs under another extension"), "hidden_archive": (REVIEW, MEDIUM, "Archives under another extension"),
    "encrypted": (REVIEW, MEDIUM, "Encrypted entries"), "duplicates": (REVIEW, MEDIUM, "Names that occur twice"), "unsafe_paths": (REVIEW, HIGH, "Names that leave their folder"), "deceptive_names": (REVIEW, HIGH, "Names with hidden signs"),
    "compression_ratio": (REVIEW, MEDIUM, "Entries that inflate very far"), "large_files": (INFO, LOW, "Large entries"), "nested_jars": (INFO, LOW, "Archives inside"), "unusual_files": (INFO, LOW, "Unusual kinds of files"), "signed": (INFO, LOW, "Signature files"),
}


def content_rules(notable: DataFrame, jars: DataFrame) -> DataFrame:
    """One finding a node and kind of notable entries, with the first places; running code in the node raises some."""
    rows = notable.select(*NODE, "entry_seq", "name", F.explode("kinds").alias("kind"))
    first = where_of(rows, [*NODE, "kind"], ["entry_seq"], "name")
    held = first.join(jars.select(*NODE, "tags"), NODE, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    where = F.col("where")
    found = []
    for kind, (severity, confidence, title) in CONTENT_RULES.items():
        s, c = F.lit(severity), F.lit(confidence)
        if kind == "executables":
            s, c = F.when(_tags("process_execution"), WARNING).otherwise(s), F.when(_tags("process_execution"), HIGH).otherwise(c)
        if kind == "disguised":
            c = F.when(_tags("dynamic_loading", "process_execution", "native_file_load"), HIGH).otherwise(c)
        found.append(_finding(f"contents.{kind}", F.col("kind") == kind, s, F.concat(F.lit(f"{title}: "), F.col("n").cast("string")), where, c))
    return _emit(held, NODE, found)


def metadata_rules(nodes: DataFrame, mods: DataFrame, entries: DataFrame, manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """Findings on the hash list, descriptors and manifest. hashes: sha256, classification, note."""
    known = nodes.join(hashes, "sha256", "left").withColumn("classification", F.coalesce("classification", F.lit("UNKNOWN")))
    of_hash = _emit(known, NODE, [
        _finding("hash.suspicious", F.col("classification") == "SUSPICIOUS", WARNING, "This exact file is listed as suspicious", None, HIGH),
        _finding("hash.verified", F.col("classification") == "VERIFIED", INFO, "This exact file is listed as verified"),
    ])
    valid = known.filter("valid")
    none = _emit(valid.join(mods.select(*NODE).distinct(), NODE, "left_anti"), NODE, [_finding("metadata.none", F.lit(True), INFO, "No descriptor")])
    seen = mods.groupBy(*NODE).agg(F.array_sort(F.collect_set(F.concat_ws(": ", "loader", "source_file"))).alias("files"))
    detected = _emit(seen, NODE, [_finding("metadata.detected", F.lit(True), INFO, "Descriptors", F.array_join("files", ", "))])
    incomplete = _emit(mods, NODE, [_finding("metadata.incomplete", (F.coalesce("mod_id", F.lit("")) == "") | (F.coalesce("version", F.lit("")) == ""), INFO, "Descriptor without an id or version", F.col("source_file"))], F.col("mod_seq"))
    firsts = mods.groupBy(*NODE, "source_file").agg(F.min_by(F.struct("mod_id", "version"), "mod_seq").alias("m")).groupBy(*NODE).agg(
        F.count("*").alias("n"), F.count_distinct(F.nullif("m.mod_id", F.lit(""))).alias("ids"), F.count_distinct(F.when(~F.contains("m.version", F.lit("${")), F.nullif("m.version", F.lit("")))).alias("versions"),
    )
    uneven = _emit(firsts, NODE, [
        _finding("metadata.inconsistent_id", (F.col("n") > 1) & (F.col("ids") > 1), REVIEW, "Descriptors disagree on the id", None, LOW),
        _finding("metadata.inconsistent_version", (F.col("n") > 1) & (F.col("versions") > 1), REVIEW, "Descriptors disagree on the version", None, LOW),
    ])
    points = mods.select(*NODE, F.explode("entry_points").alias("point")).withColumn("name", F.concat(F.translate(F.substring_index("point", "::", 1), ".", "/"), F.lit(".class")))
    missing = _emit(points.join(entries.select(*NODE, "name").distinct(), [*NODE, "name"], "left_anti"), NODE, [_finding("metadata.missing_entrypoint", F.lit(True), REVIEW, "Declared class is not there", F.col("point"), MEDIUM)])
    # Ids and names are both looked at; one known name is told once a node, where it is met first.
    value = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("ID").alias("label"), F.col("mod_id").alias("text")), F.struct(F.lit(1).alias("k"), F.lit("name").alias("label"), F.col("mod_name").alias("text"))))
    values = mods.select(*NODE, "mod_seq", "source_file", value.alias("v")).filter("coalesce(v.text, '') <> ''").withColumn("like", lookalike(F.col("v.text"), R.POPULAR_NAMES)["known"])
    norm = T.normalized_name(F.col("v.text"))
    values = values.withColumn("popular", F.coalesce("like", F.when((F.length(norm) >= 3) & norm.isin(R.POPULAR_NAMES), norm))).filter("popular is not null")
    told = values.groupBy(*NODE, "popular", F.col("like").isNotNull().alias("alike")).agg(F.min_by(F.struct("mod_seq", "source_file", "v"), F.struct("mod_seq", "v.k", "source_file")).alias("r")).select(*NODE, "popular", "alike", "r.*")
    place = F.concat(F.col("source_file"), F.lit(" "), F.col("v.label"), F.lit(": "), F.col("v.text"))
    claims = _emit(told.join(known.select(*NODE, "classification"), NODE), NODE, [
        _finding("metadata.popular_mod_claim", ~F.col("alike") & (F.col("classification") != "VERIFIED"), INFO, F.concat(F.lit("Says to be "), F.col("popular")), place),
        _finding("metadata.lookalike", F.col("alike"), REVIEW, F.concat(F.col("v.label"), F.lit(" looks like "), F.col("popular")), place, MEDIUM),
    ], F.col("mod_seq"))
    attributes = _emit(manifest, NODE, [
        _finding("manifest.main_class", F.col("key") == "Main-Class", INFO, F.concat(F.lit("Can be started: "), F.col("value")), F.col("key")),
        _finding("manifest.java_agent", F.col("key").isin(R.AGENT_ATTRIBUTES), REVIEW, F.concat(F.lit("Declares an agent: "), F.col("value")), F.col("key"), MEDIUM),
        _finding("manifest.coremod", F.col("key") == "FMLCorePlugin", INFO, F.concat(F.lit("Declares a core plug-in: "), F.col("value")), F.col("key")),
    ], F.col("position"))
    out = of_hash
    for part in (none, detected, incomplete, uneven, missing, claims, attributes):
        out = out.unionByName(part)
    return out


@dataclass
class Subjects:
    """What rules read: the tables of a triage, and evidence, which is computed for the first rule that asks for it."""

    nodes: DataFrame
    entries: DataFrame
    classes: DataFrame
    mods: DataFrame
    manifest: DataFrame
    hashes: DataFrame
    limits: Limits = Limits()
    #: once(df, name) keeps what is read several times, and runs it.
    once: Callable[[DataFrame, str], DataFrame] = lambda df, name: df

    @cached_property
    def evidence(self) -> DataFrame:
        return self.once(class_evidence(self.classes), "evidence")

    @cached_property
    def jars(self) -> DataFrame:
        return self.once(jar_evidence(self.evidence), "jars")

    @cached_property
    def notable(self) -> DataFrame:
        return inventory(self.entries, self.limits)

    @cached_property
    def bundled(self) -> DataFrame:
        return self.notable.groupBy(*NODE).agg(F.bool_or(F.array_contains("kinds", "native_libraries")).alias("bundled_native"))


#: Families of rules by name, in order of planning: from Subjects to rows of FINDING. Programs add their own with `registered`.
RULES: dict[str, Callable[[Subjects], DataFrame]] = {
    "metadata": lambda s: metadata_rules(s.nodes, s.mods, s.entries, s.manifest, s.hashes),
    "contents": lambda s: content_rules(s.notable, s.jars),
    "class_names": lambda s: class_name_rules(s.classes, s.entries),
    "archives": lambda s: jar_rules(s.jars, s.bundled),
    "classes": lambda s: class_rules(s.evidence),
    "addresses": lambda s: address_rules(s.evidence),
}
#: Columns of a rule's rows, by which a family of another program is checked as well.
FINDING = ["archive_id", "node_path", "seq", "rule_id", "severity", "confidence", "title", "location", "context"]


def registered(name: str) -> Callable:
    """Decorator: a function from Subjects to rows of FINDING as a further family of rules (or in place of one of that name)."""

    def add(plan: Callable[[Subjects], DataFrame]) -> Callable:
        RULES[name] = plan
        return plan

    return add


def all_findings(subjects: Subjects, only: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Findings of each node, at most limits.max_findings_per_rule a rule and one row for the rest of a rule; and (family, message) of the families that failed.

    Families are planned and run one by one, those in `only` alone if it is given: one that cannot be planned or fails while it runs is told and left out, the
    others' findings stay.
    """
    parts, errors = [], []
    for name in RULES if only is None else only:
        try:
            parts.append(subjects.once(RULES[name](subjects).select(*FINDING), f"rules-{name}"))
        except Cancelled:
            raise
        except Exception as e:  # a rule's own fault must not cost the other rules' findings
            errors.append((name, f"rules {name}: {type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"))
    none = "archive_id string, node_path string, seq long, rule_id string, severity string, confidence string, title string, location string, context string"
    found = reduce(DataFrame.unionByName, parts) if parts else subjects.nodes.sparkSession.createDataFrame([], none)
    return _capped(found, subjects.limits), errors


def _capped(found: DataFrame, limits: Limits) -> DataFrame:
    ranked = found.withColumns({"severity_rank": severity_rank(F.col("severity")), "confidence_rank": confidence_rank(F.col("confidence"))})
    kept = capped(ranked, [*NODE, "rule_id"], ["seq", "location", "title"], limits.max_findings_per_rule)
    rest = F.concat(F.col("n_rest").cast("string"), F.lit(" more"))
    family = F.array_position(F.array(*map(F.lit, FAMILIES)), F.substring_index("rule_id", ".", 1)).cast("int")
    return kept.select(
        *NODE, family.alias("rule_order"), "rule_id", F.coalesce("seq", F.lit(2**62)).alias("seq"), name_of(F.col("severity_rank"), R.SEVERITIES).alias("severity"), name_of(F.col("confidence_rank"), R.CONFIDENCES).alias("confidence"),
        F.when(F.col("is_rest"), rest).otherwise(F.col("title")).alias("title"), F.coalesce("location", F.lit("(archive)")).alias("location"), F.coalesce("context", F.lit("")).alias("context"), "is_rest",
    ).withColumns(_reasons())


def rolled_up_nodes(findings: DataFrame) -> DataFrame:
    """Findings at their files: those of archives inside are located `inner → place`; their INFO is left out."""
    inside = F.col("node_path") != ""
    place = F.when(inside, F.concat(F.replace("node_path", F.lit("!/"), F.lit(" → ")), F.lit(" → "), F.col("location"))).otherwise(F.col("location"))
    return findings.filter(~inside | (F.col("severity") != INFO)).withColumn("location", place)


def batch_rules(mods: DataFrame) -> DataFrame:
    """Files that declare an id which other files declare too, with the names of the first five others."""
    shared = shared_ids(mods.filter("node_path = ''"), "archive_id", "mod_id").select(F.col("owner").alias("archive_id"), F.lit("").alias("node_path"), "id", "n_owners", "others")
    others = F.transform(F.split("others", ", "), T.base_name)
    found = _finding("batch.duplicate_mod_id", F.lit(True), REVIEW, F.concat(F.lit("Id of several files: "), F.col("id")), F.concat(F.lit("also in "), where_list(others, F.col("n_owners") - 1)), LOW, F.concat(F.col("n_owners").cast("string"), F.lit(" files")))
    return _emit(shared, NODE, [found]).withColumns(_reasons())
