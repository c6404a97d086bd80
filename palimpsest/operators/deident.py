"""Reversible de-identification: ordered pass, tokens, hits, collisions, restore."""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import detection as X
from palimpsest.functions import patterns as P
from palimpsest.functions.masking import mask_expr, redact_expr
from palimpsest.functions.scale import number_rows, pinned
from palimpsest.functions.text import grams
from palimpsest.functions.splice import any_of, matches, quote, weave
from palimpsest.session import cut_lineage

MODES = ("mask", "redact", "token", "hybrid")
HIT = "array<struct<pass:int,seq:int,kind:string,original:string,replacement:string>>"

# A token is only known after the corpus-wide numbering.  Until then a hit holds
# a private-use marker.  In token mode the marker is wrapped in the letter and
# digit a token begins and ends with, so later boundary checks see the same
# neighbours.
_MARK_L, _MARK_R = chr(0xE000), chr(0xE001)
_MARK = f"{_MARK_L}(\\d+\\.\\d+){_MARK_R}"
_TOKEN_MARK = f"T{_MARK_L}(\\d+\\.\\d+){_MARK_R}0"


@dataclass(frozen=True)
class Step:
    number: int
    kind: str
    pat: Column
    hint: Column | None = None


def _marker(number: int, seq: Column) -> Column:
    return F.concat(F.lit(f"{_MARK_L}{number}."), seq.cast("string"), F.lit(_MARK_R))


def _replacement(kind: str, mode: str, number: int, value: Column, seq: Column) -> Column:
    if mode == "redact":
        return redact_expr(kind)
    if mode == "token":
        return F.concat(F.lit("T"), _marker(number, seq), F.lit("0"))
    masked = mask_expr(kind, value)
    if mode == "hybrid":
        return F.concat(masked, F.lit(P.TOKEN_OPEN), _marker(number, seq), F.lit(P.TOKEN_CLOSE))
    return masked


def _hit(number: int, seq: Column, kind: str, original: Column, replacement: Column) -> Column:
    return F.struct(
        F.lit(number).alias("pass"), seq.cast("int").alias("seq"), F.lit(kind).alias("kind"),
        original.alias("original"), replacement.alias("replacement"),
    )


def _apply(df: DataFrame, text: str, step: Step, mode: str) -> DataFrame:
    """One pass: find, record hits in ``_h<n>``, put the replacements in."""
    t, n, kind = F.col(text), step.number, step.kind
    tried = F.rlike(t, step.pat)
    if step.hint is not None:
        tried = step.hint & tried
    ok = X.is_valid(kind, F.lit("")) is not None

    def piece(v: Column, i: Column) -> Column:
        repl = _replacement(kind, mode, n, v, i)
        return F.when(X.is_valid(kind, v), repl).otherwise(v) if ok else repl

    def hit(v: Column, i: Column) -> Column:
        return _hit(n, i, kind, v, _replacement(kind, mode, n, v, i))

    found = F.col(f"_m{n}")
    hits = F.transform(found, hit)
    if ok:
        hits = F.filter(hits, lambda h: X.is_valid(kind, h["original"]))
    return df.withColumn(f"_m{n}", F.when(tried, matches(t, step.pat))).withColumns({
        text: F.when(found.isNotNull(), weave(t, step.pat, F.transform(found, piece))).otherwise(t),
        f"_h{n}": F.coalesce(hits.cast(HIT), F.array().cast(HIT)),
    })


def _apply_custom(df: DataFrame, text: str, number: int, custom: Mapping[str, str]) -> DataFrame:
    """Literal replacements, longest original first; they take no token."""
    keys = sorted((k for k in custom if k), key=len, reverse=True)
    lookup = F.create_map(*[F.lit(x) for k in keys for x in (k, custom[k])])
    pat, t = F.lit("|".join(_literal(k) for k in keys)), F.col(text)
    return (
        df.withColumn("_m", F.when(F.rlike(t, pat), matches(t, pat)))
        .withColumns({
            text: F.when(
                F.col("_m").isNotNull(), weave(t, pat, F.transform("_m", lambda v: F.element_at(lookup, v)))
            ).otherwise(t),
            f"_h{number}": F.coalesce(
                F.transform("_m", lambda v, i: _hit(number, i, "custom", v, F.element_at(lookup, v))).cast(HIT),
                F.array().cast(HIT),
            ),
        })
        .drop("_m")
    )


def _literal(value: str) -> str:
    return "\\Q" + value.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _apply_secrets(df: DataFrame, text: str, mode: str, ext: str) -> DataFrame:
    """Secret assignments, then SQL INSERT values, in code-like files only."""
    t = F.col(text)
    code = F.col(ext).isin(*P.SECRET_EXT)

    def shown(number: int, seq: Column) -> Column:
        if mode != "hybrid":
            return F.lit("***")
        return F.concat(F.lit("***" + P.TOKEN_OPEN), _marker(number, seq), F.lit(P.TOKEN_CLOSE))

    whole, value = matches(t, P.SECRET), matches(t, P.SECRET, P.SECRET_VALUE_GROUP)
    pairs = F.arrays_zip(whole.alias("w"), value.alias("v"))
    df = df.withColumn("_m", F.when(code & t.rlike(P.SECRET), pairs)).withColumns({
        text: F.when(
            F.col("_m").isNotNull(),
            weave(t, P.SECRET, F.transform("_m", lambda p, i: F.replace(p["w"], p["v"], shown(0, i)))),
        ).otherwise(t),
        "_h0": F.coalesce(
            F.transform("_m", lambda p, i: _hit(0, i, "secret", X.unquote(p["v"]), shown(0, i))).cast(HIT),
            F.array().cast(HIT),
        ),
    })
    sql = F.col(ext) == ".sql"
    df = df.withColumn("_m", F.when(sql, X.sql_secrets(t)))
    numbered = F.transform("_m", lambda s, i: F.struct(s["quoted"].alias("q"), shown(1, i).alias("r")))
    once = F.aggregate(
        numbered, t, lambda acc, s: F.call_function("array_join", F.split(acc, quote(s["q"]), 2), s["r"])
    )
    return df.withColumns({
        text: F.when(F.size("_m") > 0, once).otherwise(t),
        "_h1": F.coalesce(
            F.transform("_m", lambda s, i: _hit(1, i, "secret", s["inner"], shown(1, i))).cast(HIT),
            F.array().cast(HIT),
        ),
    }).drop("_m")


def scan_pass(df: DataFrame, mode: str = "mask", *, text: str = "text", cn: bool = False,
              surnames: str | None = None, names: Iterable[str] | None = None, names_column: str | None = None,
              custom: Mapping[str, str] | None = None, ext: str | None = None,
              kinds: Iterable[str] = P.KIND_ORDER) -> DataFrame:
    """The ordered pass.  Rewrites ``text`` and adds ``hits`` (pass, seq, kind, ...).

    Map-only.  Order: secrets (where ``ext`` names the extension column),
    full-width normalisation, custom map, names, the fourteen kinds, then the
    Chinese extras.  ``names`` is a short driver-side list; a large list comes as
    ``names_column`` (see :func:`names_in_documents`).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    passes: list[int] = []
    if ext is not None:
        df = _apply_secrets(df, text, mode, ext)
        passes += [0, 1]
    df = df.withColumn(text, X.normalize(F.col(text)))
    if custom:
        df = _apply_custom(df, text, 2, custom)
        passes.append(2)
    steps: list[Step] = []
    listed = sorted({n for n in names or () if n}, key=len, reverse=True)
    if listed:
        steps.append(Step(3, "name", F.lit("|".join(_literal(n) for n in listed))))
    if names_column:
        steps.append(Step(4, "name", any_of(F.col(names_column)), F.size(names_column) > 0))
    for i, kind in enumerate(P.KIND_ORDER):
        if kind in kinds:
            steps.append(Step(10 + i, kind, F.lit(P.KINDS[kind]), X.worth_trying(kind, F.col(text))))
    if cn:
        han = F.col(text).rlike(f"[{P.HAN}]")
        strong, weak = P.name_patterns(surnames)
        steps += [Step(30, "cn_name", F.lit(strong), han), Step(31, "cn_name", F.lit(weak), han),
                  Step(32, "cn_address", F.lit(P.CN_ADDRESS), han), Step(33, "cn_org", F.lit(P.CN_ORG), han)]
    for step in steps:
        df = _apply(df, text, step, mode)
        passes.append(step.number)
    columns = [f"_h{n}" for n in passes]
    merged = F.concat(*columns) if columns else F.array().cast(HIT)
    return df.withColumns({"hits": pinned(merged), text: pinned(F.col(text))}).drop(
        *columns, *[f"_m{n}" for n in passes])


def explode_hits(passed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per hit: ``key, pass, seq, kind, original, replacement``."""
    return passed.where(F.size("hits") > 0).select(key, F.explode("hits").alias("h")).select(key, "h.*")


def build_tokens(hits: DataFrame, position: str = "doc_id", width: float = 1_000_000) -> DataFrame:
    """``original -> token`` in first-seen order over the corpus (``T0001``, ...).

    The distinct values are reduced with map-side combine; numbering runs per
    block of ``width`` documents plus one offset per block, never in one task.
    ``position`` is the document's numeric place in the corpus order.
    """
    first = (
        hits.where(~F.col("kind").isin("custom"))
        .groupBy("original")
        .agg(F.min(F.struct(F.col(position).alias("pos"), "pass", "seq")).alias("first"))
        .select("original", "first.*")
    )
    numbered = number_rows(first, [], "pos", ["pos", "pass", "seq"], "n", width)
    digits = F.lpad(F.col("n").cast("string"), 4, "0")
    shown = F.when(F.col("n") > 9999, F.col("n").cast("string")).otherwise(digits)
    return numbered.select("original", F.concat(F.lit("T"), shown).alias("token"))


def _sealed_cut(marked: DataFrame, text: str) -> DataFrame:
    """``cut_lineage`` for rows that hold originals: text and hits go to the folder encrypted.

    The key is made for this call and kept nowhere but in the plan, so what
    the folder holds afterwards can't be read.
    """
    key = F.unhex(F.lit(secrets.token_hex(32)))
    body = marked.select(text, "hits").schema
    sealed = marked.withColumn("_sealed", F.aes_encrypt(F.to_json(F.struct(text, "hits")), key)).drop(text, "hits")
    opened = F.from_json(F.aes_decrypt("_sealed", key).cast("string"), body)
    return cut_lineage(sealed).withColumn("_open", opened).select(
        *[c for c in marked.columns if c not in (text, "hits")], F.col(f"_open.{text}").alias(text), F.col("_open.hits").alias("hits"))


def desensitize(df: DataFrame, mode: str = "hybrid", *, key: str = "doc_id", position: str | None = None,
                text: str = "text", block: float = 1_000_000, **options) -> tuple[DataFrame, DataFrame]:
    """De-identify a corpus: ``(copies[key, text], hits)``.

    ``mask`` and ``redact`` are map-only.  ``token`` and ``hybrid`` number the
    distinct values corpus-wide.  Their pass runs once and writes the
    documents that hold hits; the others are what it did not write, and of
    them it only changes full-width characters.
    """
    whole = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    passed = scan_pass(df.withColumn("_whole", whole), mode, text=text, **options).select(key, *({position} - {key, None}), "_whole", text, "hits")
    if mode in ("mask", "redact"):
        return passed.select(key, text), explode_hits(passed, key)
    marked = _sealed_cut(passed.where(F.size("hits") > 0), text)
    found = marked.select(F.col(key).alias("_key"), F.col("_whole").alias("_hash")).distinct()
    clean = df.join(found, F.col(key).eqNullSafe(F.col("_key")) & (whole == F.col("_hash")), "left_anti").select(key, X.normalize(F.col(text)).alias(text))
    hits = explode_hits(marked, key)
    tokenised = hits.where(F.col("replacement").contains(_MARK_L))  # bare *** and custom values take none
    placed = tokenised if position in (None, key) else tokenised.join(marked.select(key, position), key)
    tokens = build_tokens(placed, position or key, block)
    with_token = hits.join(tokens, "original", "left")
    known = F.concat(F.col("pass").cast("string"), F.lit("."), F.col("seq").cast("string"))
    final = F.when(
        F.col("replacement").contains(_MARK_L),
        F.regexp_replace("replacement", F.lit(_TOKEN_MARK if mode == "token" else _MARK), F.col("token")),
    ).otherwise(F.col("replacement"))
    resolved = with_token.withColumn("replacement", final)
    lookup = resolved.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(known.alias("k"), F.col("token").alias("v")))).alias("_tokens")
    )
    pat = _TOKEN_MARK if mode == "token" else _MARK
    t = F.col(text)
    dirty = marked.select(key, text).join(lookup, key).withColumn(
        text, weave(t, pat, F.transform(matches(t, pat, 1), lambda v: F.element_at("_tokens", v)))
    )
    return clean.unionByName(dirty.select(key, text)), resolved.drop("token")


def names_in_documents(df: DataFrame, names: DataFrame, *, key: str = "doc_id", text: str = "text",
                       out: str = "names") -> DataFrame:
    """Names of a (possibly huge) list that occur in each document, as an array column.

    Substrings of the few lengths names have are equi-joined to the list, so
    neither the list nor the documents go through the driver.
    """
    listed = names.select(F.btrim(F.col(names.columns[0])).alias("name")).where(F.col("name") != "").distinct()
    lengths = [r[0] for r in listed.select(F.length("name").alias("n")).distinct().collect()]
    if not lengths:
        return df.withColumn(out, X.empty_strings())
    windows = F.flatten(F.array(*[grams(F.col(text), n) for n in sorted(lengths)]))
    pieces = df.select(key, F.explode(F.array_distinct(windows)).alias("name"))
    present = pieces.join(listed, "name", "left_semi").groupBy(key).agg(F.collect_set("name").alias(out))
    return df.join(present, key, "left").withColumn(out, F.coalesce(out, X.empty_strings()))


def collisions(hits: DataFrame) -> DataFrame:
    """Replacements that stand for several originals, one row per original.

    Long form on purpose: a mask such as ``[地址]`` may stand for millions of
    originals, which must not be gathered into one array.
    """
    pairs = hits.select("replacement", "original").distinct()
    counts = pairs.groupBy("replacement").agg(F.count(F.lit(1)).alias("n_originals")).where("n_originals > 1")
    return pairs.join(counts, "replacement")


def restoration_safety(mode: str, n_collisions: Column) -> Column:
    if mode == "redact":
        return F.lit("irreversible")
    if mode != "mask":
        return F.lit("unique")
    return F.when(n_collisions > 0, "ambiguous").otherwise("unique")


def seal_mapping(hits: DataFrame, key: Column) -> DataFrame:
    """Encrypt the originals (AES-GCM); the key stays with the caller."""
    return hits.withColumn("sealed", F.base64(F.aes_encrypt(F.col("original"), key, F.lit("GCM")))).drop("original")


def open_mapping(sealed: DataFrame, key: Column) -> DataFrame:
    return sealed.withColumn(
        "original", F.aes_decrypt(F.unbase64("sealed"), key, F.lit("GCM")).cast("string")
    ).drop("sealed")


def mapping_counts(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"))


def ambiguous_replacements(hits: DataFrame) -> DataFrame:
    """Collisions worth reporting when a mapping is opened (redactions are not)."""
    return collisions(hits.where(~F.col("replacement").startswith("[REDACTED_")))


def restore(copies: DataFrame, hits: DataFrame, *, key: str = "doc_id", text: str = "text",
            kinds: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Put originals back: ``(documents, report)``.

    Per document, a replacement with several originals is left alone.  The
    report has, per document, how many replacements were restored, how many
    were ambiguous and whether the copy was missing.
    """
    chosen = hits if kinds is None else hits.where(F.col("kind").isin(*kinds))
    per_repl = chosen.groupBy(key, "replacement").agg(
        F.min("original").alias("original"), F.max("original").alias("_max")
    )
    unique = F.col("original") == F.col("_max")
    per_doc = per_repl.groupBy(key).agg(
        F.map_from_entries(
            F.collect_list(F.when(unique, F.struct(F.col("replacement").alias("k"), F.col("original").alias("v"))))
        ).alias("_map"),
        F.count_if(unique).cast("long").alias("restored"),
        F.count_if(~unique).cast("long").alias("collided"),
    )
    mapped = hits.select(key).distinct().join(per_doc, key, "left")
    joined = mapped.join(copies.select(key, F.col(text).alias("_text")), key, "left")
    t = F.col("_text")
    pat = any_of(F.map_keys("_map"))
    back = F.when(
        F.size("_map") > 0, weave(t, pat, F.transform(matches(t, pat), lambda v: F.element_at("_map", v)))
    ).otherwise(t)
    documents = joined.where(t.isNotNull()).select(key, back.alias(text))
    report = joined.select(
        key,
        F.when(t.isNull(), 0).otherwise(F.coalesce("restored", F.lit(0))).cast("long").alias("restored"),
        F.when(t.isNull(), 0).otherwise(F.coalesce("collided", F.lit(0))).cast("long").alias("collided"),
        t.isNull().alias("copy_missing"),
    )
    return documents, report


def kind_counts(passed: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Long-form counts per kind from the ordered pass."""
    return (
        passed.where(F.size("hits") > 0)
        .select(*by, F.explode("hits.kind").alias("kind"))
        .groupBy(*by, "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_counts(*frames: DataFrame) -> DataFrame:
    """Add up several ``kind, n`` frames."""
    merged = frames[0].select("kind", "n")
    for other in frames[1:]:
        merged = merged.unionByName(other.select("kind", "n"))
    return merged.groupBy("kind").agg(F.sum("n").alias("n"))


def tier_expr(kind: Column) -> Column:
    return F.when(kind.isin(*P.HIGH_RISK), P.TIER_HIGH).otherwise(P.TIER_MEDIUM)


def risk_tier(counts: DataFrame, by: Iterable[str]) -> DataFrame:
    """Highest tier per group: any high kind makes it high, anything else medium."""
    return counts.groupBy(*by).agg(
        F.when(F.bool_or(F.col("kind").isin(*P.HIGH_RISK)), P.TIER_HIGH).otherwise(P.TIER_MEDIUM).alias("tier"),
        F.sum("n").alias("n_hits"),
    )


def audit_levels(counts: DataFrame) -> DataFrame:
    """Counts per kind with the audit report's own level."""
    level = F.when(F.col("kind").isin(*P.AUDIT_HIGH), P.TIER_HIGH).otherwise(P.TIER_MEDIUM)
    return counts.select("kind", "n", level.alias("level"))


def residual_risk(safety: Column, n_skipped: Column) -> Column:
    return F.when((safety == "unique") & (n_skipped == 0), P.TIER_LOW).otherwise(P.TIER_MEDIUM)


def hold_documents(passed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with a state-secret mark, which must not be released silently."""
    n = F.size(F.filter("hits", lambda h: h["kind"] == "state_secret"))
    return passed.where(n > 0).select(key, n.cast("long").alias("n_marks"))


def hits_text(counts: DataFrame, by: Iterable[str]) -> DataFrame:
    """``kind×n，kind×n`` per group (at most one entry per kind)."""
    entry = F.struct("kind", F.concat(F.col("kind"), F.lit("×"), F.col("n").cast("string")).alias("t"))
    return counts.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "，").alias("hits_text")
    )


def run_report(hits: DataFrame, skipped: DataFrame, messy: DataFrame, mode: str) -> DataFrame:
    """One row: counts per kind, items, safety, collisions, skipped inputs, advice."""
    counts = hits.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("kind", "n")))
    total = counts.agg(F.map_from_entries(entries).alias("counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
    clash = collisions(hits).agg(F.count_distinct("replacement").alias("n_collisions")) if mode == "mask" else (
        hits.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_collisions")))
    left = skipped.groupBy("category").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("skipped"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_skipped"),
    )
    safety = restoration_safety(mode, F.col("n_collisions"))
    return (
        total.crossJoin(clash).crossJoin(left).crossJoin(messy)  # four one-row frames
        .withColumn("mode", F.lit(mode))
        .withColumn("restoration_safety", safety)
        .withColumn("residual_risk", residual_risk(F.col("restoration_safety"), F.col("n_skipped")))
    )
