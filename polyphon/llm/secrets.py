"""Secret scan with DataFrame expressions only.

Three kinds of base spans come from patterns (``assign``, ``access``, ``hex``).
The method adds ``entropy`` spans: candidate strings of one character class, of
at least ``WINDOW`` characters, in which some window of ``WINDOW`` characters
has a Shannon entropy that natural words do not reach. The entropy of a sliding
window needs the sum of c*log2(c) over the counts c of its characters; a step
takes one character in and one out, so it changes two counts and two terms.

Base spans and the parts (between separators) with a word such as ``example`` or
``test`` are cut out of a candidate; each piece of at least ``WINDOW`` characters
that is left is judged by itself, with and without the separators at its ends.
Allow-list: pieces without both a digit and a letter, and UUIDs, give no entropy
span. Base spans are never suppressed.

Places are code points, ends exclusive. Texts of any length are handled whole:
positions come from the pieces between matches, in one pass per kind.

Edge cases: null and empty texts have no spans; null or repeated doc_ids keep
their rows; an empty table gives no rows; extra columns are ignored by ``scan``
and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The base patterns, their kinds in order, and their least lengths.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}"  # whole runs, since a match takes all that follow
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes: name, the whole candidate's pattern, alphabet, least entropy in bits (the most for 20 characters is 4.32, for 16 letters 4).
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", "0123456789abcdefABCDEF", 3.0),
    ("alnum", r"^[A-Za-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.7),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 3.8),
)
UUID = r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
SEPARATORS = "+/_=-"
ALLOWED_WORDS = r"(?i)example|sample|test|dummy|placeholder"

SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
CUTS = "array<struct<start:bigint,end:bigint>>"


def _none() -> Column:
    return F.array().cast(SPANS)


def _matches(text: Column, pattern: str, kind: int, value: Column | None = None) -> Column:
    """Spans of the pattern's matches with ``value`` per match as text; pieces and matches alternate."""
    pieces, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value is None else value
    rows = F.transform(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("p"), found.alias("m"), values.alias("v")),
        lambda x: F.struct(F.length(x["p"]).cast("long").alias("before"), F.length(x["m"]).cast("long").alias("size"), x["v"].alias("value")),
    )
    folded = F.aggregate(
        rows,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["before"] + x["size"]).alias("at"),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + x["before"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["before"] + x["size"]).alias("end"), x["value"].alias("value")
                    )
                ),
            ).alias("spans"),
        ),
    )
    return folded["spans"]


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _term(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def peak_entropy(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest entropy (bits) over all windows of the text, by incremental counts."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c))
    # Each character comes with the one that leaves the window; 0 stands for none.
    leaving = F.slice(F.concat(F.array_repeat(F.lit(0), window), chars), F.lit(1), F.size(chars))
    steps = F.arrays_zip(chars.alias("i"), leaving.alias("o"))

    def step(acc: Column, x: Column) -> Column:
        inn, out = x["i"], x["o"]
        without = F.transform(acc["counts"], lambda c, k: F.when(k + 1 == out, c - 1).otherwise(c))
        gone = F.when(out > 0, _term(F.get(acc["counts"], out - 1) - 1) - _term(F.get(acc["counts"], out - 1))).otherwise(F.lit(0.0))
        now = F.get(acc["counts"], inn - 1) - F.when(inn == out, 1).otherwise(0)
        total = acc["total"] + gone + _term(now + 1) - _term(now)
        n = acc["n"] + 1
        entropy = F.log2(F.lit(float(window))) - total / window
        return F.struct(
            F.transform(without, lambda c, k: F.when(k + 1 == inn, c + 1).otherwise(c)).alias("counts"),
            total.alias("total"),
            n.alias("n"),
            F.when(n >= window, F.greatest(acc["best"], entropy)).otherwise(acc["best"]).alias("best"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0.0).alias("best")
    )
    return F.aggregate(steps, start, step)["best"]


def _is_random(text: Column) -> Column:
    """Whether a candidate's class finds enough entropy in it."""
    found = F.lit(False)
    for _, pattern, alphabet, least in reversed(CLASSES):
        found = F.when(F.regexp_like(text, F.lit(pattern)), peak_entropy(text, alphabet) >= least).otherwise(found)
    mixed = F.regexp_like(text, F.lit("[0-9]")) & F.regexp_like(text, F.lit("[A-Za-z]"))
    return F.when(mixed & ~F.regexp_like(text, F.lit(UUID)), found).otherwise(F.lit(False))


def _listed_parts(candidate: Column) -> Column:
    """Places of the parts between separators that hold a word of the allow-list."""
    parts = F.split(candidate["value"], "[^A-Za-z0-9]")
    start = F.struct(candidate["start"].alias("at"), F.array().cast(CUTS).alias("cuts"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        own = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(F.regexp_like(part, F.lit(ALLOWED_WORDS)), F.concat(acc["cuts"], own)).otherwise(acc["cuts"]).alias("cuts"))

    found = F.aggregate(parts, start, step)["cuts"]
    return F.when(F.regexp_like(candidate["value"], F.lit(ALLOWED_WORDS)), found).otherwise(F.array().cast(CUTS))


def _pieces(candidate: Column) -> Column:
    """What is left of a candidate without base spans and listed parts, where it is long enough."""
    touching = F.filter("base", lambda b: (b["start"] < candidate["end"]) & (candidate["start"] < b["end"]))
    cuts = F.transform(touching, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    cuts = F.array_sort(F.concat(cuts, _listed_parts(candidate)))
    # A last cut at the end closes the last piece.
    closed = F.concat(cuts, F.array(F.struct(candidate["end"].alias("start"), candidate["end"].alias("end"))))
    start = F.struct(candidate["start"].alias("at"), F.array().cast(CUTS).alias("left"))

    def step(acc: Column, cut: Column) -> Column:
        own = F.array(F.struct(acc["at"].alias("start"), cut["start"].alias("end")))
        return F.struct(
            F.greatest(acc["at"], cut["end"]).alias("at"),
            F.when(cut["start"] - acc["at"] >= WINDOW, F.concat(acc["left"], own)).otherwise(acc["left"]).alias("left"),
        )

    def piece(x: Column) -> Column:
        size = x["end"] - x["start"]
        value = F.substring(candidate["value"], (x["start"] - candidate["start"] + 1).cast("int"), size.cast("int"))
        whole = size == candidate["end"] - candidate["start"]
        return F.struct(
            x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"), value.alias("value"),
            F.when(whole, value).otherwise(F.btrim(value, F.lit(SEPARATORS))).alias("inner"),
        )

    return F.transform(F.aggregate(closed, start, step)["left"], piece)


def _is_secret(piece: Column) -> Column:
    """Whether the piece, or what is inside the separators at its ends, is random."""
    inner = F.length(piece["inner"]) >= WINDOW
    listed = F.regexp_like(piece["inner"], F.lit(UUID))
    cut = piece["inner"] != piece["value"]
    return F.when(inner & _is_random(piece["inner"]), True).when((cut | ~inner) & ~listed, _is_random(piece["value"])).otherwise(False)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans``: sorted arrays of (start, kind number, end); the kinds are ``KINDS``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lower = F.lower(text)
    named = F.lit(False)
    for word in ASSIGN_WORDS:
        named = named | F.contains(lower, F.lit(word))
    assigned = F.filter(
        _matches(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))), lambda s: F.length(s["value"]) >= ASSIGN_LENGTH
    )
    docs = docs.withColumns(
        {
            "assign_spans": F.when(named, _plain(assigned)).otherwise(_none()),
            "access_spans": F.when(F.contains(text, F.lit("AKIA")), _plain(_matches(text, ACCESS, 1))).otherwise(_none()),
            "hex_spans": F.when(F.regexp_like(text, F.lit(HEX)), _plain(_matches(text, HEX, 2))).otherwise(_none()),
            "candidate_spans": F.when(F.regexp_like(text, F.lit(CANDIDATE)), _matches(text, CANDIDATE, 3)).otherwise(
                F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
            ),
        }
    )
    docs = docs.withColumn("base", F.array_sort(F.concat("assign_spans", "access_spans", "hex_spans")))
    docs = docs.withColumn("pieces", F.flatten(F.transform("candidate_spans", _pieces)))
    docs = docs.withColumn("spans", F.array_sort(F.concat("base", _plain(F.filter("pieces", _is_secret)))))
    return docs.drop("assign_spans", "access_spans", "hex_spans", "candidate_spans", "pieces")


def _written(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, counts per base kind, ``base_sha256``, ``spans`` as text, ``n_entropy``."""
    rows = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return rows.select("doc_id", *counts[:3], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), counts[3])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span replaced in the text; overlapping spans are one."""
    # The row travels as one value, so its columns may have any names.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = with_spans(whole)
    folded = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["parts"], F.array(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")))),
            ).otherwise(acc["parts"]).alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], mark), F.lit(mark), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))),
    )
    text = F.when(F.size("spans") > 0, folded).otherwise(F.col("text"))
    return rows.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
