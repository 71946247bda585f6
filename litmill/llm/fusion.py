"""Best representative of each duplicate group.

Every record of a group makes claims: one per usable value of a single-valued field, one per value
of a multi-valued field. A latent two-sided quality model gives each source, field by field, a
sensitivity (the share of true values it names) and a specificity (the share of false ones it does
not), and each claimed value a posterior of being true. The two are fitted by expectation
maximisation over claim patterns - which sources cover a group and which of them name the value -
so the fit sees all facts of all groups, yet works on their distinct patterns.

A multi-valued field keeps every value whose posterior reaches `keep`; a single-valued field takes
one value, by posterior or, where a trust order is stated, by that, then recency, then the posterior.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill.operators.packed_values import packed_values
from litmill.session import distinct_names, materialize

#: Patterns up to which the fit runs on the driver; beyond, the same rounds run as aggregations.
DRIVER_PATTERNS = 200_000
#: Most rounds of the fit, and the change of any rate below which it rests.
ROUNDS, STILL = 40, 1e-3
#: Prior claims: rates of sources hardly seen lie at sensitivity 7/10, specificity 8/10; truth at 6/10.
SENSITIVE, SPECIFIC, TRUE, STRENGTH = 7.0, 8.0, 6.0, 10.0

#: Stand-ins for "missing", compared trimmed and in small letters.
MISSING = ("", "-", "n/a", "none", "null", "unknown")

#: Spellings of true, compared trimmed and in small letters.
TRUE_WORDS = ("1", "on", "true", "y", "yes")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def usable_text(c: Column) -> Column:
    """The trimmed value, or null if it is missing, a stand-in for missing, or cut off."""
    t = trimmed(c)
    return F.when(~F.lower(t).isin(*MISSING) & ~t.rlike(r"(…|\.\.\.)$"), t)


def bare_doi(c: Column) -> Column:
    """`10.…/…` in small letters, without resolver or scheme; null if there is no whole DOI."""
    d = F.regexp_extract(F.lower(trimmed(c)), r"^(?:doi:\s*|info:doi/|https?://[^/\s]+/)*(10\.\d{4,9}/[^\s…]*[^\s….,;)])[.,;)]?$", 1)
    return F.when(d != "", d)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)).isin(*TRUE_WORDS), F.lit(False))


def source_trust(sources: DataFrame) -> DataFrame:
    """source, trust, src: a number for each source; 0 is left for unknown ones.

    Repeated sources keep their highest trust, null being 0; null sources are dropped.
    """
    s = distinct_names(sources, "source", "trust").where("source is not null").groupBy("source").agg(F.max("trust").alias("trust"))
    return s.select("source", F.coalesce("trust", F.lit(0)).alias("trust"), F.xxhash64("source").alias("src"))


def fit_on_driver(field: np.ndarray, n: np.ndarray, pattern: np.ndarray, key: np.ndarray, said: np.ndarray, fields: int, keys: int):
    """(sensitivity, specificity per key, prior per field, posterior per pattern) by EM.

    field and n are given per pattern; pattern, key (a source in a field) and said per pattern and
    source that covers it.
    """
    sens, spec, prior = np.full(keys, SENSITIVE / STRENGTH), np.full(keys, SPECIFIC / STRENGTH), np.full(fields, TRUE / STRENGTH)
    add = lambda w: np.bincount(key, w, keys)
    for k in range(ROUNDS):
        gain = np.where(said, np.log(sens / (1 - spec))[key], np.log((1 - sens) / spec)[key])
        t = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior))[field] + np.bincount(pattern, gain, len(n)), -500, 500)))
        w1, w0 = (n * t)[pattern], (n * (1 - t))[pattern]
        new = (
            np.clip((add(w1 * said) + SENSITIVE) / (add(w1) + STRENGTH), 0.01, 0.99), np.clip((add(w0 * ~said) + SPECIFIC) / (add(w0) + STRENGTH), 0.01, 0.99),
            np.clip((np.bincount(field, n * t, fields) + TRUE) / (np.bincount(field, n, fields) + STRENGTH), 0.01, 0.99),
        )
        moved = max(np.abs(x - y).max(initial=0.0) for x, y in zip(new, (sens, spec, prior)))
        sens, spec, prior = new
        if moved < STILL:
            break
    return sens, spec, prior, t


def fit_distributed(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As `fit_on_driver`, as aggregations over (field, source): (quality, posteriors) of patterns (pattern, field, claim, cover, n)."""
    long = materialize(patterns.select("pattern", "field", "n", F.explode("cover").alias("src"), "claim").select("pattern", "field", "n", "src", F.array_contains("claim", F.col("src")).alias("said")))
    clip = lambda c: F.greatest(F.lit(0.01), F.least(F.lit(0.99), c))
    quality = materialize(long.select("field", "src").distinct().withColumns({"sensitivity": F.lit(SENSITIVE / STRENGTH), "specificity": F.lit(SPECIFIC / STRENGTH), "prior": F.lit(TRUE / STRENGTH)}))
    each = None
    for _ in range(ROUNDS):
        gain = F.when(F.col("said"), F.log(F.col("sensitivity") / (1 - F.col("specificity")))).otherwise(F.log((1 - F.col("sensitivity")) / F.col("specificity")))
        total = F.log(F.col("prior") / (1 - F.col("prior"))) + F.sum(gain).over(W.partitionBy("pattern"))
        each = materialize(long.join(quality, ["field", "src"]).select("pattern", "field", "n", "src", "said", (1 / (1 + F.exp(-total))).alias("t")), *([each] if each is not None else []))
        w1, w0 = F.col("n") * F.col("t"), F.col("n") * (1 - F.col("t"))
        of = lambda w, c: F.sum(F.when(c, w).otherwise(0.0))
        rates = each.groupBy("field", "src").agg(
            clip((of(w1, F.col("said")) + SENSITIVE) / (F.sum(w1) + STRENGTH)).alias("sensitivity"), clip((of(w0, ~F.col("said")) + SPECIFIC) / (F.sum(w0) + STRENGTH)).alias("specificity")
        )
        priors = each.groupBy("pattern", "field").agg(F.first("n").alias("n"), F.first("t").alias("t")).groupBy("field").agg(clip((F.sum(F.col("n") * F.col("t")) + TRUE) / (F.sum("n") + STRENGTH)).alias("prior"))
        new = materialize(rates.join(priors, "field"))
        old = quality.select("field", "src", *[F.col(c).alias(f"old_{c}") for c in ("sensitivity", "specificity", "prior")])
        moved = new.join(old, ["field", "src"]).agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"old_{c}")) for c in ("sensitivity", "specificity", "prior")]))).first()[0]
        quality = new
        if moved is None or moved < STILL:
            break
    return quality, each.groupBy("pattern").agg(F.first("t").alias("posterior"))


class Fusion:
    """Survivors of all groups of records.

    records: one row per record with the key, source, updated_at and the fields.
    single: field -> column of its usable value (null if it has none).
    multi: field -> column of an array of values.
    flags: field -> boolean column; the survivor's flag is true if any record's is.

    Null keys form no group. Null and unknown sources count as one source of trust 0; a null
    updated_at is earliest. Groups of one record are left out. Ties beyond trust, time and posterior
    go to the smallest value. Empty tables give empty results; columns of other names are ignored.

    A hot group costs nothing extra: records are reduced to distinct (key, field, value) claims by
    map-side combining before anything is gathered, and no list of a group is ever built.
    """

    def __init__(self, records: DataFrame, sources: DataFrame, key: str, single: dict[str, Column], multi: dict[str, Column], flags: dict[str, Column] | None = None):
        flags = flags or {}
        self.key, self.fields, self.multi, self.flags = key, [*single, *flags, *multi], list(multi), list(flags)
        number = {f: k for k, f in enumerate(self.fields)}
        one = [F.array(F.struct(F.lit(number[f]).alias("field"), c.cast("string").alias("value"))) for f, c in (single | flags).items()]
        many = [_numbered(c, number[f]) for f, c in multi.items()]
        record = F.array(F.struct(F.lit(-1).alias("field"), F.lit(None).cast("string").alias("value")))
        flat = records.where(F.col(key).isNotNull()).select(
            F.col(key).alias("k"), F.col("source").alias("src"), F.col("updated_at").alias("at"), F.concat(record, *one, *many).alias("claims")
        )
        self.sources = source_trust(sources)
        claims = flat.join(self.sources, flat.src == self.sources.source, "left").select(
            "k", "at", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce(self.sources.src, F.lit(0)).alias("src"), F.explode("claims").alias("c")
        )
        facts = (
            claims.where("c.field < 0 or c.value is not null")
            .groupBy("k", F.col("c.field").alias("field"), F.col("c.value").alias("value"))
            .agg(F.max(F.struct("trust", "at")).alias("best"), F.collect_set("src").alias("claim"), F.count("*").alias("n"))
        )
        self.facts = materialize(facts.withColumn("claim", F.array_sort("claim")))

    def _grouped(self) -> DataFrame:
        """The facts of groups of two or more records."""
        return self.facts.where("field >= 0").drop("n").join(self.facts.where("field < 0 and n > 1").select("k"), "k")

    def _patterned(self) -> DataFrame:
        # a set has at most as many members as there are sources, whatever the size of the group
        facts = self._grouped()
        cover = facts.select("k", "field", F.explode("claim").alias("src")).groupBy("k", "field").agg(F.array_sort(F.collect_set("src")).alias("cover"))
        return facts.join(cover, ["k", "field"]).withColumn("pattern", F.xxhash64("field", "claim", "cover"))

    def resolve(self, driver_patterns: int = DRIVER_PATTERNS) -> tuple[DataFrame, DataFrame]:
        """(key, field, value, trust, at, posterior) of every fact in groups of two or more records, and the model.

        The model is (field, src, sensitivity, specificity, prior) for each source, src 0 for unknown ones.
        """
        spark = self.facts.sparkSession
        patterned = materialize(self._patterned())
        patterns = materialize(patterned.groupBy("pattern").agg(F.first("field").alias("field"), F.first("claim").alias("claim"), F.first("cover").alias("cover"), F.count("*").alias("n")))
        if patterns.count() > driver_patterns:
            quality, table = fit_distributed(patterns)
            return patterned.join(table, "pattern"), quality
        rows = patterns.orderBy("pattern").collect()
        keys = {}
        long = [(k, keys.setdefault((r["field"], c), len(keys)), c in r["claim"]) for k, r in enumerate(rows) for c in r["cover"]]
        at, key, said = (np.array(x, ty) for x, ty in zip(list(zip(*long)) or ((), (), ()), (int, int, bool)))
        fit = fit_on_driver(np.array([r["field"] for r in rows], int), np.array([r["n"] for r in rows], float), at, key, said, len(self.fields), len(keys))
        quality = spark.createDataFrame([(f, c, float(fit[0][k]), float(fit[1][k]), float(fit[2][f])) for (f, c), k in keys.items()], "field int, src bigint, sensitivity double, specificity double, prior double")
        table = spark.createDataFrame([(r["pattern"], float(p)) for r, p in zip(rows, fit[3])], "pattern bigint, posterior double")
        # at most driver_patterns rows of 16 bytes
        return patterned.join(F.broadcast(table), "pattern"), quality

    def source_quality(self) -> DataFrame:
        """(field_name, source, sensitivity, specificity) of the fitted model; a null source stands for all unknown ones."""
        names = F.array(*[F.lit(f) for f in self.fields])
        return self.resolve()[1].join(self.sources, "src", "left").select(names[F.col("field")].alias("field_name"), "source", "sensitivity", "specificity")

    def survivors(self, keep: float = 0.5, by_trust: bool = True, fit: bool = True) -> DataFrame:
        """(key, field_name, field_value, posterior): the record built for each group of two or more records.

        by_trust: single values and flags by trust, time, posterior, and a flag is true if any record
        says so; else by posterior, trust, time. Full ties go to the smallest value. Without the fit
        posteriors are null, decide nothing, and all values of multi-valued fields stay.
        """
        if not (fit or by_trust):
            raise ValueError("survivors by posterior need the fit")
        facts = self.resolve()[0] if fit else self._grouped().withColumn("posterior", F.lit(None).cast("double"))
        multi = [k for k, f in enumerate(self.fields) if f in self.multi]
        flags = [k for k, f in enumerate(self.fields) if f in self.flags]
        names = F.array(*[F.lit(f) for f in self.fields])
        stated = [F.col("best.trust").alias("trust"), F.col("best.at").alias("at")]
        claimed = F.col("field").isin(flags) & (F.col("value") == "true")
        first = [claimed.alias("claimed"), *stated, F.col("posterior")] if by_trust else [F.col("posterior"), *stated]
        ranked = facts.where(~F.col("field").isin(multi)).groupBy("k", "field").agg(F.max_by(F.struct("value", "posterior"), F.struct(*first, _descending(F.col("value")).alias("last"))).alias("top"))
        one = ranked.select("k", "field", "top.value", "top.posterior")
        many = facts.where(F.col("field").isin(multi) & (F.col("posterior") >= keep if fit else F.lit(True))).select("k", "field", "value", "posterior")
        return one.unionByName(many).select(F.col("k").alias(self.key), names[F.col("field")].alias("field_name"), F.col("value").alias("field_value"), "posterior")


def _numbered(values: Column, number: int) -> Column:
    known = F.coalesce(values, F.array().cast("array<string>"))
    return F.transform(known, lambda v: F.struct(F.lit(number).alias("field"), v.alias("value")))


def _descending(c: Column) -> Column:
    """A key that falls as the string rises, for picking the smallest string inside a max()."""
    return F.concat(F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def paper_fusion(papers: DataFrame, sources: DataFrame) -> Fusion:
    """The Fusion of literature records by canonical_id: doi, venue and is_favorite single, tags multi-valued."""
    p = distinct_names(papers, "canonical_id", "source", "updated_at", "doi", "venue", "tags", "is_favorite")
    tags = F.transform(packed_values(F.col("tags")), lambda v: F.lower(v["value"]))
    return Fusion(
        p.withColumn("tags", F.array_distinct(tags)).withColumn("favorite", truthy(F.col("is_favorite"))),
        sources,
        "canonical_id",
        {"doi": bare_doi(F.col("doi")), "venue": usable_text(F.col("venue"))},
        {"tags": F.col("tags")},
        {"is_favorite": F.col("favorite")},
    )
