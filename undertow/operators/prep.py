"""Flow preparation: canonical form, clocks, scenarios, gaps, splits, samples and sequence windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions import scalars as S
from undertow.operators import ordered
from undertow.session import broadcast_if_small, cut_lineage
from undertow.spec import RESERVED_ENTITIES, FlowSpec

CORE = ["flow_id", "entity_id", "ts", "label"]


# --------------------------------------------------------------------------- canonical form


def fill_missing(df: DataFrame, cat_cols, num_cols) -> DataFrame:
    """Missing categories read '-', missing numbers read 0."""
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in cat_cols},
            **{c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in num_cols},
        }
    )


def to_canonical(raw: DataFrame, spec: FlowSpec, flow_id: str = "flow_id") -> DataFrame:
    """Text rows of a source -> typed wide flows. Without a time column the synthetic clock is used."""
    have = set(raw.columns)
    pick = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
    label = S.resolve_label(pick(spec.label_col), pick(spec.sublabel_col) if spec.sublabel_col else None)
    entity = pick(spec.entity_col) if spec.entity_col else None
    cols = [
        F.col(flow_id).cast("long").alias("flow_id"),
        S.resolve_entity(entity, F.col(flow_id), spec.entity_modulo).alias("entity_id"),
        *[F.coalesce(pick(c), F.lit("-")).alias(c) for c in spec.cat_cols],
        *[S.safe_float(pick(c)).alias(c) for c in spec.num_cols],
        label.alias("label"),
    ]
    if spec.time_col and spec.time_col in have:
        return raw.select(cols[0], cols[1], S.safe_float(pick(spec.time_col)).alias("ts"), *cols[2:])
    duration = S.safe_float(pick(spec.duration_col)) if spec.duration_col else F.lit(0.0)
    return synthetic_clock(raw.select(*cols, duration.alias("_dur")), "_dur").drop("_dur")


def synthetic_clock(df: DataFrame, duration: str) -> DataFrame:
    """ts = running sum of max(duration, 0.001) in row order."""
    step = F.greatest(F.col(duration).cast("double"), F.lit(0.001))
    return ordered.prefix_sums(df, ["flow_id"], {"ts": step})


def flows_to_maps(df: DataFrame, cat_cols, num_cols) -> DataFrame:
    pairs = lambda cols: F.create_map(*[x for c in cols for x in (F.lit(c), F.col(f"`{c}`"))])
    rest = [c for c in df.columns if c not in {*cat_cols, *num_cols}]
    return df.select(*rest, pairs(cat_cols).alias("categorical_fields"), pairs(num_cols).alias("numerical_fields"))


def maps_to_flows(df: DataFrame, cat_cols, num_cols) -> DataFrame:
    rest = [c for c in df.columns if c not in ("categorical_fields", "numerical_fields")]
    return df.select(
        *rest,
        *[F.coalesce(F.col("categorical_fields")[c], F.lit("-")).alias(c) for c in cat_cols],
        *[F.coalesce(F.col("numerical_fields")[c], F.lit(0.0)).alias(c) for c in num_cols],
    )


# --------------------------------------------------------------------------- scenarios

# Two labelled scenarios, each step being (seconds after the first flow, fields).
DNS_TUNNEL = ("dns_tunnel", "10.0.0.901", {"proto": "udp", "service": "dns", "state": "INT", "is_ftp_login": "0", "is_sm_ips_ports": "0"}, (
    (10.0, {}, {"dur": 0.001, "spkts": 2.0, "dpkts": 2.0, "sbytes": 120.0, "dbytes": 240.0, "rate": 2000.0}),
    (460.0, {}, {"dur": 0.001, "spkts": 2.0, "dpkts": 2.0, "sbytes": 130.0, "dbytes": 260.0, "rate": 2000.0}),
    (1810.0, {}, {"dur": 0.001, "spkts": 2.0, "dpkts": 2.0, "sbytes": 150.0, "dbytes": 300.0, "rate": 2000.0}),
))
PASS_THE_HASH = ("pass_the_hash", "10.0.0.902", {"proto": "tcp", "state": "CON", "is_ftp_login": "0", "is_sm_ips_ports": "0"}, (
    (20.0, {"service": "auth"}, {"dur": 0.5, "spkts": 4.0, "dpkts": 4.0, "sbytes": 450.0, "dbytes": 450.0, "rate": 16.0}),
    (30.0, {"service": "smb"}, {"dur": 1.2, "spkts": 10.0, "dpkts": 8.0, "sbytes": 1200.0, "dbytes": 800.0, "rate": 15.0}),
    (35.0, {"service": "lsass_dump", "state": "FIN"}, {"dur": 3.4, "spkts": 50.0, "dpkts": 45.0, "sbytes": 54000.0, "dbytes": 2000.0, "rate": 28.0}),
))
SCENARIOS = (DNS_TUNNEL, PASS_THE_HASH)


def inject(df: DataFrame, cat_cols, num_cols, scenarios=SCENARIOS) -> DataFrame:
    """Append the scenario rows, timed from the first flow; fields a scenario leaves open are '-' or 0.

    The rows are exploded from the one-row minimum, so nothing is joined and nothing is collected.
    """
    step = T.StructType(
        [T.StructField("entity_id", T.StringType()), T.StructField("offset", T.DoubleType())]
        + [T.StructField(c, T.StringType()) for c in cat_cols]
        + [T.StructField(c, T.DoubleType()) for c in num_cols]
    )
    literals = []
    for _, entity, shared, steps in scenarios:
        for offset, cats, nums in steps:
            fields = {**shared, **cats}
            literals.append(
                F.struct(
                    F.lit(entity).alias("entity_id"),
                    F.lit(offset).alias("offset"),
                    *[F.lit(str(fields.get(c, "-"))).alias(c) for c in cat_cols],
                    *[F.lit(float(nums.get(c, 0.0))).alias(c) for c in num_cols],
                ).cast(step)
            )
    first = df.agg(F.min("ts").alias("_t0"), F.max("flow_id").alias("_last"))
    rows = first.filter(F.col("_t0").isNotNull()).select("_t0", "_last", F.posexplode(F.array(*literals)).alias("_i", "s"))
    made = rows.select(
        (F.col("_last") + F.col("_i") + 1).cast("long").alias("flow_id"),
        F.col("s.entity_id").alias("entity_id"),
        (F.col("_t0") + F.col("s.offset")).alias("ts"),
        *[F.col("s")[c].alias(c) for c in cat_cols],
        *[F.col("s")[c].alias(c) for c in num_cols],
        F.lit(1).alias("label"),
    )
    return df.unionByName(made, allowMissingColumns=True)


# --------------------------------------------------------------------------- gaps and splits


def with_dt(df: DataFrame, rows_per_slice: int = ordered.ROWS_PER_SLICE) -> DataFrame:
    """Seconds since the entity's previous flow; 0 for the first, never negative."""
    seen = ordered.sliced_order(df, "entity_id", ["ts", "flow_id"], lags={"_prev": "ts"}, rows_per_slice=rows_per_slice)
    gap = F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(F.greatest(F.col("ts") - F.col("_prev"), F.lit(0.0)))
    return seen.withColumn("dt", gap).drop("_prev")


def cut_points(n: int, train: float, val: float) -> tuple[int, int]:
    """How many of n shuffled entities go to train, and to train plus val. Both of val and test get one."""
    if n <= 2:
        return min(n, 1), n
    # validation first, then at least one for the test part; training gets what both leave of its share
    middle = max(1, ordered.share_of(n, val))
    head = ordered.share_of(n, train)
    end = min(head + middle, n - 1)
    return (head if head + middle < n else min(head, end - 1)), end


def split_map(
    df: DataFrame,
    ratios: tuple[float, float, float] = (0.70, 0.15, 0.15),
    seed: int = 42,
    pinned=RESERVED_ENTITIES,
) -> DataFrame:
    """(entity_id, split): entities ranked by a seeded hash and cut at exact counts; pinned ones are test.

    A null entity is an entity like others; it ranks first.
    """
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("split ratios must sum to 1")
    entities = df.select("entity_id").distinct()
    held = F.coalesce(F.col("entity_id").isin(*pinned), F.lit(False))
    free = entities.filter(~held).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("entity_id"))))
    n = free.count()
    train_cut, val_cut = cut_points(n, ratios[0], ratios[1])
    ranked = ordered.row_numbers(free, ["_h", "entity_id"], "_rank")
    named = ranked.select(
        "entity_id",
        F.when(F.col("_rank") <= train_cut, "train").when(F.col("_rank") <= val_cut, "val").otherwise("test").alias("split"),
    )
    return named.unionByName(entities.filter(held).select("entity_id", F.lit("test").alias("split")))


def tag_split(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Attach each flow's split, that of null to flows without entity; the entity table is broadcast only when its size was checked."""
    named = broadcast_if_small(splits.withColumnRenamed("entity_id", "_entity"))
    return df.join(named, F.col("entity_id").eqNullSafe(F.col("_entity"))).drop("_entity")


def split_entities(df: DataFrame, ratios=(0.70, 0.15, 0.15), seed: int = 42, pinned=RESERVED_ENTITIES) -> DataFrame:
    return tag_split(df, split_map(df, ratios, seed, pinned))


# --------------------------------------------------------------------------- samples


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """First n rows in row order."""
    return df.orderBy("flow_id").limit(n)


def stride_sample(df: DataFrame, stride: int) -> DataFrame:
    return df.filter(F.col("flow_id") % stride == 0) if stride > 1 else df


def first_ids(df: DataFrame, n: int) -> DataFrame:
    """Rows holding the n smallest flow ids, found by rank selection instead of a sort."""
    total = df.count()
    if n <= 0:
        return df.limit(0)
    if n >= total:
        return df
    cut = ordered.value_at_rank(df, "flow_id", [n - 1])[n - 1]
    return df.filter(F.col("flow_id") <= int(cut))


def head_per_class(df: DataFrame, n: int, label: str = "label") -> DataFrame:
    """First n normals and first n anomalies."""
    return first_ids(df.filter(F.col(label) == 0), n).unionByName(first_ids(df.filter(F.col(label) == 1), n))


def normals(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label") == 0)


def attacks(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label") == 1)


def normal_holdout(df: DataFrame, fit_share: float = 0.6) -> DataFrame:
    """role = fit for the first share of normals, eval_normal for the rest, eval_attack for as many attacks."""
    good, bad = normals(df), attacks(df)
    n = good.count()
    n_fit = ordered.share_of(n, fit_share)
    fit = first_ids(good, n_fit)
    if n_fit == 0:
        fit_cut = -1
    else:
        fit_cut = int(ordered.value_at_rank(good, "flow_id", [n_fit - 1])[n_fit - 1])
    return (
        fit.withColumn("role", F.lit("fit"))
        .unionByName(good.filter(F.col("flow_id") > fit_cut).withColumn("role", F.lit("eval_normal")))
        .unionByName(first_ids(bad, n - n_fit).withColumn("role", F.lit("eval_attack")))
    )


def calibration_rows(df: DataFrame) -> DataFrame:
    """Validation normals; else train normals; else all of validation."""
    counts = {
        (r["split"], r["label"]): r["n"] for r in df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    if counts.get(("val", 0)):
        return df.filter((F.col("split") == "val") & (F.col("label") == 0))
    if counts.get(("train", 0)):
        return df.filter((F.col("split") == "train") & (F.col("label") == 0))
    return df.filter(F.col("split") == "val")


def keep_latest(df: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Newest `capacity` rows of a bounded backlog, and how many were dropped."""
    dropped = max(0, df.count() - capacity)
    return df.orderBy(F.col("ts").desc(), F.col("flow_id").desc()).limit(capacity), dropped


# --------------------------------------------------------------------------- sequence windows


def window_length(df: DataFrame, length: int = 16) -> int:
    """The asked length, or 8, 4, 2 when no entity is that long; 1 when none has three rows."""
    longest = df.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for candidate in (length, 8, 4, 2):
        if candidate <= length and longest > candidate:
            return candidate
    return 1


def window_members(df: DataFrame, length: int = 16, rows_per_slice: int = ordered.ROWS_PER_SLICE) -> DataFrame:
    """One row per (window, position): starts every length/2 while a full shifted target fits.

    A row belongs to at most three windows, so the table grows by a constant factor.
    """
    numbered = ordered.sliced_order(df, "entity_id", ["ts", "flow_id"], row_number="_pos", rows_per_slice=rows_per_slice)
    if length == 1:
        return numbered.withColumns({"start": F.col("_pos") - 1, "pos": F.lit(0).cast("long")}).drop("_pos")
    sizes = df.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n"))
    stride = max(length // 2, 1)
    i = F.col("_pos") - 1
    first = F.greatest(F.ceil((i - length) / F.lit(stride)), F.lit(0)).cast("long")
    last = F.least(F.floor(i / F.lit(stride)), F.floor((F.col("_n") - length - 1) / F.lit(stride))).cast("long")
    placed = numbered.join(sizes, "entity_id").filter(F.col("_n") > length)
    return (
        placed.withColumns({"_first": first, "_last": last})
        .filter(F.col("_last") >= F.col("_first"))
        .withColumn("_w", F.explode(F.sequence("_first", "_last")))
        .withColumn("start", F.col("_w") * stride)
        .withColumn("pos", F.col("_pos") - 1 - F.col("start"))
        .drop("_pos", "_n", "_first", "_last", "_w")
    )


def sequence_windows(df: DataFrame, value: str | Column, length: int = 16, **kw) -> DataFrame:
    """Windows as arrays: x = rows i..i+L-1, y = the same shifted by one, dts = gaps of x.

    Grouping is by (entity, start), so a group never holds more than length + 1 rows.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = window_members(df.withColumn("_value", value), length, **kw)
    packed = F.sort_array(F.collect_list(F.struct("pos", "_value", "dt", "label")))
    grouped = rows.groupBy("entity_id", "start").agg(packed.alias("_m"))
    if length == 1:
        return grouped.select(
            "entity_id", "start", F.col("_m._value").alias("x"), F.col("_m._value").alias("y"),
            F.array(F.lit(0.0)).alias("dts"), F.col("_m.label").alias("y_labels"),
        )
    return grouped.select(
        "entity_id",
        "start",
        F.slice("_m._value", 1, length).alias("x"),
        F.slice("_m._value", 2, length).alias("y"),
        F.slice("_m.dt", 1, length).alias("dts"),
        F.slice("_m.label", 2, length).alias("y_labels"),
    )


def window_hardness(df: DataFrame, length: int = 16, **kw) -> DataFrame:
    """(entity_id, start, hardness): mean label of the window's targets."""
    rows = window_members(df, length, **kw)
    targets = rows.filter(F.col("pos") >= 1) if length > 1 else rows
    return targets.groupBy("entity_id", "start").agg(F.avg(F.col("label").cast("double")).alias("hardness"))


def curriculum_sample(hardness: DataFrame, epoch: int) -> DataFrame:
    """Windows of one epoch: share min(0.3 + 0.3 epoch, 0.8) of hard ones, both lists cycled to length.

    How often a window appears follows from its rank, so it is repeated in place; no join is needed.
    """
    hardness = cut_lineage(hardness)  # counted and ranked in several passes
    easy = hardness.filter(F.col("hardness") == 0)
    hard = hardness.filter(F.col("hardness") > 0)
    n_easy, n_hard = easy.count(), hard.count()
    if not n_easy or not n_hard:
        return ordered.row_numbers(hardness, ["entity_id", "start"], "_r").select(
            "entity_id", "start", "hardness", (F.col("_r") - 1).alias("slot")
        )
    total = n_easy + n_hard
    take_hard = ordered.share_of(total, min(round(0.3 + 0.3 * epoch, 9), 0.8))
    take_easy = total - take_hard

    def cycle(part: DataFrame, size: int, take: int, shift: int) -> DataFrame:
        r = F.col("_r") - 1
        ranked = ordered.row_numbers(part, ["entity_id", "start"], "_r").filter(r < take)
        copies = F.floor((F.lit(take - 1) - r) / F.lit(size))
        return ranked.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), copies))).select(
            "entity_id", "start", "hardness", (F.col("_c") * size + r + shift).alias("slot")
        )

    return cycle(easy, n_easy, take_easy, 0).unionByName(cycle(hard, n_hard, take_hard, take_easy))
