"""Secret scans: candidate spans by native expressions, judged by corpus-wide ownership.

``scan`` adds the spans of every kind of candidate; positions come from the
lengths of what lies between the matches, so no user function is needed.
``ownership`` counts, for every candidate's hash, the distinct repositories
and owners that hold it.  A value that ``COPIED_OWNERS`` or more owners hold,
or ``COPIED_REPOSITORIES`` or more repositories, is a widely copied example;
one below both that has a live look (length and variety of characters) is a
live secret.  Both bounds are fixed, not derived from the corpus.

Counting goes over (value, owner, repository), then (value, owner), then
value, with partial aggregates before each shuffle, so a value that a third of
all rows holds reaches the last step as one row per owner and task.  Verdicts
return to the rows by the hash of all a row's candidates.  Rows without a
candidate take no part in that; the verdicts of the ``HOT`` most frequent sets
of candidates, a table of bounded size, are broadcast, so that rows that agree
in theirs aren't sent to one task.

Defined results: a null text counts as empty and has no spans; a text of any
length is scanned whole, in time that grows with its length; repeated rows
get equal spans and verdicts, and count once for ownership if repository and
owner agree; a null owner or repository is one owner or repository of its
own; spans of equal start follow their kinds as listed; an empty table gives
an empty one.  Columns of the input stay, whatever their names, but for those
named like a result, which give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, spare
from millrace.llm.skew import Hot
from millrace.storage import materialize

_ANY_CASE = {w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")}
_KEYWORDS = "|".join([*_ANY_CASE.values(), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
_NAMED = f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

_END = "-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_GAP = "(?:[\\s\"'>|#*,]|\\\\[nr])*+"
#: Header lines of a key, of bounded number and length, so that a text of many BEGIN lines is not read again for each.
_HEAD = f"(?:{_GAP}[A-Z][A-Za-z0-9-]{{0,63}}+:[^\\n\\\\]{{0,512}}+){{0,16}}+"
_RUN = "[A-Za-z0-9+/=]"
#: A private key with its body: all up to the END line, or without that line (a text that was cut) the lines that look like a key.
#: A header that no key follows is not a secret.  Repetition is possessive, so that Java's matcher neither recurses nor goes back over a long body.
_PEM = (
    f"-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----(?={_HEAD}{_GAP}{_RUN}{{12}})"
    f"([^-]*+(?:-(?!----)[^-]*+)*+(?={_END})|{_HEAD}(?:{_GAP}{_RUN}{{12,}}+)++(?:{_GAP}{_RUN}++(?=\\s*+$))?+)(?:{_END})?+"
)

#: (kind, pattern, group that holds the value, least length of the value); the first three are the base.
KINDS = (
    ("assign", _NAMED, 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", 0, 28),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("payment", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("pem", _PEM, 1, 20),
    ("url", "[a-z][a-z0-9+]{1,20}://[^\\s:@/]{1,256}:([^\\s:@/]{6,256})@", 1, 6),
)
N_BASE = 3
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 100
HOT, HOT_VALUES = 1000, 1000
LIVE_LENGTH, LIVE_VARIETY = 8, 6
_BLOCK = 256


def _prefix_sums(steps: Column) -> Column:
    """Running sums of an array in blocks, so that a long array costs less than its square."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def sums(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(a) / _BLOCK).cast("int")), lambda b: total(F.slice(a, b * _BLOCK + 1, _BLOCK)))
        heads = lambda h: F.transform(h, lambda _, b: total(F.slice(h, 1, b)))
        inner = lambda at, i: total(F.slice(a, i - i % _BLOCK + 1, i % _BLOCK + 1)) + F.get(at, (i / _BLOCK).cast("int"))
        return let(let(blocks, heads), lambda at: F.transform(a, lambda _, i: inner(at, i)))

    return let(steps, sums)


def _spans(text: Column, order: int) -> Column:
    """Spans of one kind: what lies between the matches gives their places."""
    kind, pattern, group, least = KINDS[order]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def place(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return let(
            gaps,
            lambda g: _prefix_sums(F.transform(m, lambda _, i: F.length(F.get(g, i)) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0)))),
        )

    def build(m: Column) -> Column:
        rows = F.arrays_zip(place(m).alias("start"), m.alias("match"), (m if group == 0 else value).alias("value"))
        spans = F.transform(
            rows,
            lambda r: F.struct(
                r["start"].alias("start"),
                F.lit(order).alias("ord"),
                F.lit(kind).alias("kind"),
                (r["start"] + F.length(r["match"])).alias("end"),
                r["value"].alias("value"),
            ),
        )
        return F.filter(spans, lambda s: F.length(s["value"]) >= least)

    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(whole, build)).otherwise(none)


def scan(docs: DataFrame, text: str = "text", output: str = "spans") -> DataFrame:
    """``docs`` with ``output``: spans of (start, ord, kind, end, value), by start and then by kind as listed."""
    t = spare(docs, "t__")
    found = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    return found.withColumn(output, F.sort_array(F.concat(*(_spans(F.col(t), k) for k in range(len(KINDS)))))).drop(t)


def digest(value: Column) -> Column:
    """What ownership is counted by; line breaks, written out or not, don't make another key of the same body."""
    return F.sha2(F.regexp_replace(value, "\\s|\\\\[nr]", ""), 256)


def live_look(value: Column) -> Column:
    """Long and varied enough to be a credential rather than a placeholder."""
    return (F.length(value) >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_VARIETY)


def ownership(candidates: DataFrame, value: str = "value_hash", owner: str = "owner", repository: str = "repository") -> DataFrame:
    """One row per candidate hash: ``n_repositories``, ``n_owners`` and ``copied``.  A repository belongs to its owner."""
    per_owner = candidates.groupBy(value, owner, repository).agg(F.lit(1).alias("one")).groupBy(value, owner).agg(F.count("one").alias("repos"))
    counts = per_owner.groupBy(value).agg(F.sum("repos").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    return counts.withColumn("copied", (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES))


#: What ``judge`` adds.
JUDGED = ("secret_key", "live", "n_live", "n_copied", "most_owners", "most_repositories")


def judge(found: DataFrame, owner: str, repository: str, spans: str = "spans") -> DataFrame:
    """Judge a scanned table that is written and read again, so that it is scanned once.

    Adds ``secret_key`` (equal for rows with equal candidates, null without one), ``live`` (hashes of live secrets),
    ``n_live`` and ``n_copied`` (distinct values), and ``most_owners`` and ``most_repositories`` (of any one value of
    the row; 0 without candidates).  Only (key, hash) pairs are shuffled beside the rows.
    """
    kept = [c for c in found.columns if c.lower() not in JUDGED]
    hashes = F.array_distinct(F.transform(F.filter(spans, lambda s: live_look(s["value"])), lambda s: digest(s["value"])))
    rows = found.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), hashes.alias("hashes"), F.col(owner).alias("owner"), F.col(repository).alias("repository")
    )
    rows = rows.withColumn("secret_key", F.when(F.size("hashes") > 0, F.sha2(F.array_join("hashes", ","), 256)))
    with_any = rows.where("secret_key IS NOT NULL")
    held = with_any.select(F.explode("hashes").alias("value_hash"), "owner", "repository", "secret_key")
    keyed = materialize(held.groupBy("secret_key", "value_hash").agg(F.count(F.lit(1)).alias("rows")), "secret-keys")
    # a copied value beside many others is one value of many keys
    hot = Hot(keyed.groupBy("value_hash").agg(F.count(F.lit(1)).alias("keys")), "value_hash", "keys")
    owned = hot.join(keyed, materialize(ownership(held), "secret-owners"), F.col("secret_key"))
    per_key = owned.groupBy("secret_key").agg(
        F.sort_array(F.collect_list(F.when(~F.col("copied"), F.col("value_hash")))).alias("live"),
        F.count_if("copied").alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
        F.max("rows").alias("rows"),
    )
    per_key = materialize(per_key, "secret-verdicts")
    # at most HOT rows of at most HOT_VALUES hashes
    hot = F.broadcast(per_key.where(F.size("live") <= HOT_VALUES).orderBy(F.desc("rows"), "secret_key").limit(HOT).drop("rows"))
    cold = per_key.drop("rows").join(hot.select("secret_key"), "secret_key", "left_anti")
    rows = rows.select("row", "secret_key")
    near = rows.join(hot, "secret_key", "left")
    none = F.col("secret_key").isNull() | F.col("live").isNotNull()
    far = near.where(~none).select("row", "secret_key").join(cold, "secret_key")
    out = near.where(none).select(far.columns).union(far)
    zero = F.lit(0).cast("long")
    return out.select(
        *(F.col(f"row.`{c}`") for c in kept),
        "secret_key",
        F.coalesce("live", F.array().cast("array<string>")).alias("live"),
        F.size(F.coalesce("live", F.array().cast("array<string>"))).cast("long").alias("n_live"),
        *(F.coalesce(c, zero).alias(c) for c in JUDGED[3:]),
    )


def redact_live(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """The documents with every live secret's value replaced by ``[secret]``; copied examples and all other text stay."""
    boxed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.col(text).alias("body"),
        F.col(owner).alias("owner"),
        F.col(repository).alias("repository"),
    )
    found = materialize(scan(boxed, "body").drop("body"), "secret-spans")
    judged = judge(found, "owner", "repository")

    def clean(body: Column, spans: Column, live: Column) -> Column:
        values = F.array_distinct(F.transform(F.filter(spans, lambda s: F.array_contains(live, digest(s["value"]))), lambda s: s["value"]))
        longest = F.transform(F.sort_array(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), asc=False), lambda x: x["v"])
        return F.aggregate(longest, body, lambda acc, v: F.replace(acc, v, F.lit("[secret]")))

    cleaned = F.when(F.col("n_live") > 0, clean(F.col(f"doc.`{text}`"), F.col("spans"), F.col("live"))).otherwise(F.col(f"doc.`{text}`"))
    return judged.select(*(cleaned.alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns))
