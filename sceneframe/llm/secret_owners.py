"""Secret scan with corpus-wide ownership of the candidates.

Spans come from three base patterns and from bare tokens that look like live credentials. The value of every candidate is
hashed; over the whole corpus a hash is counted by distinct repositories and by distinct owners. A value that one owner
alone holds, in few repositories, is a live-looking credential; one that several owners or many repositories hold is a
copied example, also where all of these belong to one owner. Bare tokens become spans only where they are live; base spans
always stay.

Positions are code points. They follow from the matches and the pieces between them, so everything is an array expression
of the row; only candidates (hash, repository, owner) are shuffled, pre-aggregated, and joined back by hash, where AQE may
split a hash that a third of all rows hold.

Defined results: a null text counts as empty. A null repository or owner is no repository or owner, so a candidate whose
owner is unknown everywhere is never live. Every row keeps a row of its own, repeated ``doc_id`` included; such rows are one
repository. Texts of any length are scanned whole. An empty table gives no row. Only the named columns are read, so others
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.llm.text import let, running_totals, whole_text
from sceneframe.session import written

# fixed patterns and least lengths of the base kinds, in the order that breaks ties
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "owned"]
MIN_ASSIGNED = 12

# a bare token: a whole run of token characters with digits and letters, of many different characters
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
MIN_DIFFERENT = 10

FEW_REPOSITORIES = 5  # a credential is used in some places of its owner; more than these are copies

SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """All leftmost, non-overlapping matches with their code point positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(hits: Column) -> Column:
        between = F.split(text, pattern)
        steps = F.transform(hits, lambda hit, i: (
            F.length(between[i]) + F.when(i > 0, F.length(hits[i - 1])).otherwise(0)).cast("bigint"))
        values = hits if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        return let(running_totals(steps), lambda starts: let(values, lambda vs: F.transform(hits, lambda hit, i: F.struct(
            starts[i].alias("start"), F.lit(kind).alias("kind"), (starts[i] + F.length(hit)).alias("end"), vs[i].alias("value")))))

    return let(found, lambda hits: F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(located(hits)))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind: ``array<struct<start, kind, end, value>>``."""
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= MIN_ASSIGNED)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def bare_tokens(text: Column, base: Column) -> Column:
    """Live-looking bare tokens that overlap no base span."""
    varied = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= MIN_DIFFERENT
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(_spans(text, BARE, 3), lambda s: varied(s["value"]) & free(s))


def scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row per document, written once: ``row``, the carried columns, ``repository``, ``owner``, ``base`` and ``bare``.

    Spans carry the hash of their value instead of the value.
    """
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    rows = docs.select(
        *[F.col(c).alias(f"c_{c}") for c in carry or []],
        F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
        whole_text(text).alias("_text"),
    ).withColumn("_base", base_spans(F.col("_text"))).withColumn("_bare", bare_tokens(F.col("_text"), F.col("_base")))
    return written(rows.select(
        F.monotonically_increasing_id().alias("row"), *[f"c_{c}" for c in carry or []], "repository", "owner",
        hashed(F.col("_base")).alias("base"), hashed(F.col("_bare")).alias("bare"),
    ), "secret-spans")


def candidates(scanned: DataFrame) -> DataFrame:
    """Distinct candidate hashes of each row."""
    hashes = F.array_distinct(F.transform(F.concat("base", "bare"), lambda s: s["hash"]))
    return scanned.select("row", "repository", "owner", F.explode(hashes).alias("hash"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every candidate hash."""
    held = found.groupBy("hash", "repository", "owner").agg(F.lit(1).alias("one"))
    return held.groupBy("hash").agg(
        F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))


def classified(scanned: DataFrame, few: int = FEW_REPOSITORIES) -> DataFrame:
    """The scanned rows with ``live`` (hashes of one owner and at most ``few`` repositories) and ``n_copied`` (of more of either)."""
    found = candidates(scanned)
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") <= few)
    copied = (F.col("n_owners") > 1) | (F.col("n_repositories") > few)
    verdicts = (
        found.select("row", "hash").join(ownership(found), "hash")
        .groupBy("row").agg(
            F.collect_list(F.when(live, F.col("hash"))).alias("live"),
            F.count(F.when(copied, 1)).alias("n_copied"),
            F.max("n_repositories").alias("most_repositories"),
        )
    )
    # rows without a candidate need no join partner, and only they lack one
    return scanned.join(verdicts, "row", "left").withColumns({
        "live": F.coalesce("live", F.array().cast("array<string>")),
        "n_copied": F.coalesce("n_copied", F.lit(0).cast("bigint")),
        "most_repositories": F.coalesce("most_repositories", F.lit(0).cast("bigint")),
    }).withColumn("spans", F.array_sort(F.concat(
        "base", F.filter("bare", lambda s: F.array_contains(F.col("live"), s["hash"])))))


def rendered(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def report(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", key: str = "doc_id") -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans, live and copied candidates."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return classified(scan(docs, text, repository, owner, [key])).select(
        F.col(f"c_{key}").alias(key), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"),
        F.size("live").cast("bigint").alias("n_live"), "n_copied", "most_repositories",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by ``mark``; spans are sorted by start."""
    # a span opens a run when no earlier one reaches its start; runs end where the next one opens
    reach = lambda i: F.array_max(F.transform(F.slice(spans, 1, i), lambda s: s["end"]))
    opens = F.filter(F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("start"), F.when(i > 0, reach(i)).otherwise(F.lit(0)).alias("from"), i.alias("i"))),
        lambda s: (s["i"] == 0) | (s["start"] >= s["from"]))
    before = F.transform(opens, lambda o: F.substring(text, (o["from"] + 1).cast("int"), (o["start"] - o["from"]).cast("int")))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    tail = F.substring(text, (last + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat_ws(mark, F.concat(before, F.array(tail))))


def redact(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", length: str | None = "n_chars") -> DataFrame:
    """The documents with all base spans and live bare tokens blanked out, in their own columns.

    ``length`` names the column that holds the number of characters and is set anew where the text changes.
    """
    rows = classified(scan(docs, text, repository, owner, docs.columns))
    carried = {c: F.col(f"c_{c}") for c in docs.columns}
    touched = F.size("spans") > 0
    rows = rows.withColumn("clean", F.when(touched, redacted(carried[text], F.col("spans"))).otherwise(carried[text]))
    new = {text: F.col("clean"), length: F.when(touched, F.length("clean").cast("bigint")).otherwise(carried.get(length, F.lit(None)))}
    return rows.select(*[new.get(c, carried[c]).alias(c) for c in docs.columns])
