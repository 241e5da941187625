"""Secret scan with multipart credential linking, in DataFrame functions alone.

Some parts are secrets by their form and always reported: assigned values,
access keys, long hexadecimal runs. Others mean something only together: a
short password next to a user name, a 40-character token next to an endpoint.
Those weak parts become intervals, and an interval join within a scope around
each finds the complementary ones; a weak part without any is not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswork.llm.inputs import numbered, texts, written

# The forms of the base kinds, and the least length of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LENGTH = 8

# Weak parts: identifiers, secrets and endpoints that count only together.
WEAK_ID = r"""(?i)\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?i)\b(?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]{2,20})://[^\s"'<>]+|\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:_-]{3,}"""
WEAK_LENGTH = 4

KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
SCOPE = 200
# Texts with spans whose spans are broadcast; beyond that Spark joins them.
BROADCAST_ROWS = 50_000
_BIN = 256
_SPANS, _PIECES = "array<struct<s:int,e:int,n:int>>", "array<struct<s:int,e:int>>"
# Elements that a fold copies at most at each step.
_CHUNK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an outer expression inside a lambda is computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_chunks(items: Column, total, start, fold, kind: str) -> Column:
    """What a left fold over an array gives per element, without copying the whole result at each of them.

    The array is cut into chunks. ``total(chunk)`` sums a chunk up,
    ``start(before, total)`` carries the state over it, and ``fold(chunk,
    state)`` makes the elements of one chunk (an array of ``kind``). Only chunks
    and the short list of their states are copied as they grow.
    """
    def chunked(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _CHUNK).cast("int"))
        return F.transform(numbers, lambda c: F.slice(all_, c * _CHUNK + 1, F.lit(_CHUNK)))

    def states(chunks: Column) -> Column:
        return F.aggregate(F.transform(chunks, total), F.array(F.lit(0)), lambda done, x: F.concat(
            done, F.array(start(F.element_at(done, -1), x))))

    def folded(chunks: Column) -> Column:
        pairs = F.arrays_zip(chunks.alias("c"), states(chunks).alias("s"))
        return F.flatten(F.transform(F.slice(pairs, F.lit(1), F.size(chunks)), lambda x: fold(x["c"], x["s"])))

    made = _let(items, lambda all_: F.when(F.size(all_) > 0, _let(chunked(all_), folded)))
    return F.coalesce(made, F.array().cast(kind))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, as (start, end, length of a group) in code points.

    The texts between the matches come from a split on the same pattern, so
    lengths add up to positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")

    def lengths(m: Column) -> Column:
        sized = F.zip_with(F.slice(m["p"], F.lit(1), F.size(m["m"])), m["m"], lambda p, x: F.struct(F.length(p).alias("p"), F.length(x).alias("m")))
        if not group:
            return F.transform(sized, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), x["m"].alias("g")))
        return F.zip_with(sized, m["g"], lambda x, g: F.struct(x["p"].alias("p"), x["m"].alias("m"), F.length(g).alias("g")))

    def fold(chunk: Column, at: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            begin = done["at"] + x["p"]
            end = begin + x["m"]
            return F.struct(end.alias("at"), F.concat(done["spans"], F.array(F.struct(
                begin.alias("s"), end.alias("e"), x["g"].alias("n")))).alias("spans"))

        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("spans")), step, lambda done: done["spans"])

    found = _let(F.struct(F.split(text, pattern, -1).alias("p"), whole.alias("m"), part.alias("g")), lambda m: _in_chunks(
        lengths(m), lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["p"] + x["m"]), lambda before, n: before + n, fold, _SPANS))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(_SPANS))


def _tagged(spans_: Column, kind: int) -> Column:
    return F.transform(spans_, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _joined(sorted_spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(sorted_spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, doc_id, base, parts) in a written table: base spans, and all parts with role, strength and place."""
    text = F.col("_text")
    rows = texts(docs, id_col, text_col).select(
        F.col("_id").alias("doc_id"), spans(text, ASSIGN, 2).alias("assigned"),
        F.when(text.contains("AKIA"), spans(text, ACCESS)).otherwise(F.array().cast(_SPANS)).alias("access"),
        spans(text, HEX).alias("hex"), spans(text, WEAK_ID).alias("ids"), spans(text, WEAK_SECRET).alias("secrets"),
        spans(text, ENDPOINT).alias("endpoints"))
    strong = F.filter("assigned", lambda x: x["n"] >= ASSIGN_LENGTH)
    short = F.filter("assigned", lambda x: (x["n"] >= WEAK_LENGTH) & (x["n"] < ASSIGN_LENGTH))

    def parts(spans_: Column, role: str, weak: bool) -> Column:
        return F.transform(spans_, lambda x: F.struct(
            F.lit(role).alias("role"), F.lit(weak).alias("weak"), x["s"].alias("s"), x["e"].alias("e")))

    base = F.array_sort(F.concat(_tagged(strong, 0), _tagged(F.col("access"), 1), _tagged(F.col("hex"), 2)))
    every = F.concat(
        parts(F.col("access"), "id", False), parts(F.col("ids"), "id", True), parts(strong, "secret", False),
        parts(short, "secret", True), parts(F.col("secrets"), "secret", True), parts(F.col("endpoints"), "endpoint", True))
    out = rows.select("doc_id", base.alias("base"), every.alias("parts"))
    return written(out.withColumn("row", F.monotonically_increasing_id()), "secret-scan")


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows (row, linked): the weak parts with a complementary part within ``scope`` code points.

    A secret needs an identifier or an endpoint, an identifier a secret, an
    endpoint both. The join is on (row, stretch of text), so a text full of
    parts is spread and a part meets only those near it.
    """
    parts = scanned.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    reach = parts.filter("weak").select(
        "row", F.col("role").alias("own"), F.col("s").alias("from"), F.col("e").alias("to"),
        F.explode(F.sequence(F.floor((F.greatest(F.col("s") - scope, F.lit(0))) / _BIN), F.floor((F.col("e") + scope) / _BIN))).alias("bin"))
    # A part belongs to the stretches it touches; a pair that meets twice counts once in the maxima below.
    placed = parts.select("row", "role", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / _BIN), F.floor(F.col("e") / _BIN))).alias("bin"))
    near = (F.col("s") < F.col("to") + scope) & (F.col("e") > F.col("from") - scope) & (F.col("role") != F.col("own"))
    met = reach.join(placed, ["row", "bin"]).filter(near).groupBy("row", "own", "from", "to").agg(
        *[F.max((F.col("role") == r).cast("int")).alias(f"has_{r}") for r in ("id", "secret", "endpoint")])
    kept = ((F.col("own") == "secret") & (F.col("has_id") + F.col("has_endpoint") > 0)) | (
        (F.col("own") == "id") & (F.col("has_secret") > 0)) | (
        (F.col("own") == "endpoint") & (F.col("has_id") > 0) & (F.col("has_secret") > 0))
    kind = F.when(F.col("own") == "id", 3).when(F.col("own") == "secret", 4).otherwise(5)
    # One list per text, of its own spans.
    return met.filter(kept).groupBy("row").agg(F.collect_set(F.struct(
        F.col("from").alias("s"), kind.alias("k"), F.col("to").alias("e"))).alias("linked"))


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, found), one per input row: all spans (s, k, e) by start, then kind as in ``KINDS``.

    Null and empty texts have none; repeated rows are scanned each; null ids stay null.
    """
    scanned = scan(docs, id_col, text_col)
    joined = scanned.join(link(scanned.filter(F.exists("parts", lambda p: p["weak"])), scope), "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    return joined.select("doc_id", "base", every.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the text of all spans."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.col("found")).alias("spans"), (F.size("found") - F.size("base")).cast("long").alias("n_linked"))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with every span of the text replaced by ``mark``; texts without one are untouched.

    Rows are numbered, so spans meet their text again even where ids repeat or
    are null. A null text stays null.
    """
    names = docs.columns
    rows = numbered(docs, id_col)
    text = F.col("_doc").getField(text_col)
    found = find_secrets(rows.select(F.col("_row").alias("doc_id"), text.alias("text"))).filter(F.size("found") > 0)
    found = written(found.select(F.col("doc_id").alias("_row"), "found"), "secret-spans")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    joined = rows.join(found, "_row", "left")

    def kept(chunk: Column, at: Column) -> Column:
        """The stretches of text before each span that no earlier span covers."""
        def step(done: Column, x: Column) -> Column:
            piece = F.when(x["s"] >= done["at"], F.array(F.struct(done["at"].alias("s"), x["s"].alias("e")))).otherwise(
                F.array().cast(_PIECES))
            return F.struct(F.greatest(done["at"], x["e"]).alias("at"), F.concat(done["out"], piece).alias("out"))

        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(_PIECES).alias("out")), step, lambda done: done["out"])

    # Spans may overlap: a piece of text is kept from the furthest end so far to the next start.
    end = F.aggregate("found", F.lit(0), lambda far, x: F.greatest(far, x["e"]))
    pieces = _in_chunks(F.col("found"), lambda c: F.aggregate(c, F.lit(0), lambda far, x: F.greatest(far, x["e"])), F.greatest, kept, _PIECES)
    pieces = F.concat(pieces, F.array(F.struct(end.alias("s"), F.length(text).alias("e"))))
    # Four bytes a code point: a piece is cut out without walking the text from its start.
    cut = _let(F.encode(text, "UTF-32"), lambda wide: F.transform(pieces, lambda x: F.decode(
        F.substring(wide, x["s"] * 4 + 1, (x["e"] - x["s"]) * 4), "UTF-32")))
    new = F.when(F.col("found").isNull(), text).otherwise(F.array_join(cut, mark))
    return joined.select(*[new.alias(c) if c == text_col else F.col("_doc").getField(c).alias(c) for c in names])
