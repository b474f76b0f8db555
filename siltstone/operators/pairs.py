"""Pair datasets: geometry and metadata reasons, nested strings, family metrics, deranged donors. Columns are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scratch import fresh, stored

#: Words of other postures, of cut-off bodies, and of pictures of pictures.
AMBIGUOUS_POSTURE = r"(?i)\b(crouch(?:ed|ing)?|kneel(?:ed|ing)?|squat(?:ted|ting)?|crawl(?:ed|ing)?|lying|laying)\b"
TRUNCATION_CONTEXT = r"(?i)\b(portraits?|headshots?|selfies?|close[ -]?ups?|podiums?)\b"
SECONDARY_MEDIA = (
    r"(?i)\b(drawings?|illustrations?|cartoons?|statues?|sculptures?|dolls?|toys?|mannequins?|posters?|advertisements?|magazines?"
    r"|newspapers?|books?|screens?|televisions?|paintings?|artworks?|figurines?|photos?|photographs?)\b"
)


def string_leaves(c: Column, kind: T.DataType) -> Column:
    """All strings of a value of any nesting (structs, arrays, maps' values), in order; nulls and other types have none."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        got = F.array(c)
    elif isinstance(kind, T.StructType):
        got = F.concat(none, *(string_leaves(c.getField(f.name), f.dataType) for f in kind.fields))
    elif isinstance(kind, T.ArrayType):
        got = F.flatten(F.transform(c, lambda x: string_leaves(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        got = F.flatten(F.transform(F.map_values(c), lambda x: string_leaves(x, kind.valueType)))
    else:
        return none
    return F.when(c.isNull(), none).otherwise(got)


def geometry_reason(class_name: Column, attribute: Column, text: Column, width: Column, height: Column, classes: Sequence[str], wanted: str, limits: dict[str, float]) -> Column:
    """The first reason against a box, or pass. The reason codes are fixed values; limits: min_width, max_width,
    min_height, min_area, min_bbox_height_to_width."""
    no = lambda c: F.coalesce(c, F.lit(True))
    return (
        F.when(no(~class_name.isin(*classes)), "non_target_class")
        .when(no(attribute != wanted), "non_standing_attribute")
        .when(F.coalesce(text, F.lit("")).rlike(AMBIGUOUS_POSTURE), "ambiguous_posture_term")
        .when(F.coalesce(text, F.lit("")).rlike(TRUNCATION_CONTEXT), "obvious_truncation_context_term")
        .when(no(width < limits["min_width"]), "small_width")
        .when(no(width > limits["max_width"]), "excessive_width_closeup_risk")
        .when(no(height < limits["min_height"]), "small_height")
        .when(no(width * height < limits["min_area"]), "small_area")
        .when(no(height / width < limits["min_bbox_height_to_width"]), "short_bbox_aspect")
        .otherwise("pass")
    )


def metadata_reason(subset: Column, licence: Column, author: Column, landing_url: Column, rotation: Column, title: Column, wanted_subset: str, wanted_licence: str) -> Column:
    """The first reason against an image's metadata, or pass. The reason codes are fixed values; rotation is text."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    turned = F.when(empty(rotation), F.lit(0.0)).otherwise(rotation.try_cast("double"))
    return (
        F.when(F.coalesce(subset != wanted_subset, F.lit(True)), "wrong_subset")
        .when(F.coalesce(licence != wanted_licence, F.lit(True)), "license_rejection")
        .when(empty(author) | empty(landing_url), "missing_attribution")
        .when(turned.isNull(), "invalid_rotation")
        .when(turned != 0, "nonzero_rotation")
        .when(F.coalesce(title, F.lit("")).rlike(SECONDARY_MEDIA), "secondary_media_title")
        .otherwise("pass")
    )


VARIANTS, PRIMARY = ("base", "edited", "invariant"), ("base", "edited")


def family_metrics(df: DataFrame, condition: str, task: str, candidates: str, answers: Sequence) -> DataFrame:
    """Percentages for each condition, over all tasks (task is null) and by task.

    df has a row per family and condition: the three predictions (base, edited, invariant), what is expected of them
    (expected_base and so on) and the candidate answers (an array). A family is right where base and edited are; a
    prediction is valid where it is a candidate. n_<variant>_<answer> count predictions."""
    hit = {v: F.coalesce(F.col(v) == F.col(f"expected_{v}"), F.lit(False)) for v in VARIANTS}
    valid = {v: F.coalesce(F.array_contains(candidates, F.col(v)), F.lit(False)) for v in VARIANTS}
    percent = lambda *cs: F.round(100 * F.avg(sum(c.cast("double") for c in cs) / len(cs)), 9)
    return df.groupingSets([[condition], [condition, task]], condition, task).agg(
        F.count("*").alias("families"),
        percent(hit["base"] & hit["edited"]).alias("joint"),
        percent(hit["base"] & hit["invariant"]).alias("base_invariant"),
        percent(*(hit[v] for v in PRIMARY)).alias("ordinary_primary"),
        percent(*hit.values()).alias("ordinary_all"),
        *(percent(hit[v]).alias(f"{v}_accuracy") for v in VARIANTS),
        percent(*(valid[v] for v in PRIMARY)).alias("valid_primary"),
        percent(*valid.values()).alias("valid_all"),
        percent(F.coalesce(F.col("base") == F.col("edited"), F.lit(False))).alias("same_prediction"),
        *(F.count_if(F.col(v) == F.lit(a)).alias(f"n_{v}_{a}") for v in VARIANTS for a in answers),
    )


def deranged_donors(df: DataFrame, strata: list[str], order: str, cluster: str, image: str) -> DataFrame:
    """All columns and donor, the `order` value of each row's donor: within a stratum, in order, the rows are rotated by the
    least shift that gives no row a donor of its own cluster or image. Fails where a stratum has no such shift.

    A round tries one shift for all strata still open, so its work is linear and no pairs are made."""
    i, n, bad = fresh([*df.columns, "donor"], "place", "rows", "bad")
    w = Window.partitionBy(*strata)
    left = stored(df.withColumns({i: F.row_number().over(w.orderBy(order)) - 1, n: F.count("*").over(w)}), "ranked")
    done, shift = None, 0
    while True:
        shift += 1
        if left.where(F.col(n) <= shift).limit(1).count():
            raise ValueError("a stratum cannot be deranged across clusters and images")
        donors = left.select(*(F.col(c).alias(f"s{k}") for k, c in enumerate(strata)), F.col(i).alias("at"), F.col(order).alias("donor"), F.col(cluster).alias("c"), F.col(image).alias("im"))
        on = (F.pmod(F.col(i) + shift, F.col(n)) == F.col("at")) & F.lit(True)
        for k, c in enumerate(strata):
            on = on & F.col(c).eqNullSafe(F.col(f"s{k}"))
        met = left.join(donors, on).withColumn(bad, F.max((F.col(cluster).eqNullSafe(F.col("c")) | F.col(image).eqNullSafe(F.col("im"))).cast("int")).over(w))
        met = stored(met.select(*left.columns, "donor", bad), "rotated")
        good = met.where(F.col(bad) == 0).select(*df.columns, "donor")
        done = good if done is None else done.unionByName(good)
        left = met.where(F.col(bad) == 1).select(*left.columns)
        if not left.limit(1).count():
            return done


def crop_box(patch: Column, grid: int, expansion: float = 1.0) -> Column:
    """Struct x1, y1, x2, y2, from 0 to 1: the patch's cell of a grid x grid image and `expansion` cells around it, cut at the
    edges; null for a patch outside the grid."""
    margin, side = expansion / grid, F.lit(float(grid))
    across, down = patch % grid, F.floor(patch / grid)
    box = F.struct(
        F.greatest(across / side - margin, F.lit(0.0)).alias("x1"),
        F.greatest(down / side - margin, F.lit(0.0)).alias("y1"),
        F.least((across + 1) / side + margin, F.lit(1.0)).alias("x2"),
        F.least((down + 1) / side + margin, F.lit(1.0)).alias("y2"),
    )
    return F.when(patch.between(0, grid * grid - 1), box)


def evidence_action(logits: Column, gain: Column, least_gain: float, least_probability: float) -> Column:
    """The most probable patch (the first of equals) if its softmax probability and the gain reach their floors, else the
    last index, which means stop."""
    top = F.array_max(logits)
    probability = 1 / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    stop = F.size(logits) - 1
    best = F.array_position(logits, top).cast("int") - 1
    return F.when((gain >= least_gain) & (probability >= least_probability), best).otherwise(stop)


def difference_hash(grey: Column, width: int = 8, height: int = 8) -> Column:
    """Bits of height rows of width + 1 grey values, 1 where a value is above the next one; the first is the highest."""
    at = lambda k, d: F.get(grey, (F.floor(k / width) * (width + 1) + k % width + d).cast("int"))
    ks = F.sequence(F.lit(0), F.lit(width * height - 1))
    return F.aggregate(ks, F.lit(0).cast("long"), lambda a, k: F.shiftleft(a, 1).bitwiseOR((at(k, 0) > at(k, 1)).cast("long")))
