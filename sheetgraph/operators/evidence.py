"""Evidence anchors and the gate that decides what may be promoted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Source types that need a place in the document, and which assets a reason blocks.
LOCATABLE = ("datasheet_text", "datasheet_table", "datasheet_drawing", "ocr")
ASSETS = ("symbol", "footprint", "model3d", "figures")
GEOMETRY, PIN = ("footprint", "model3d"), ("symbol", "footprint", "model3d")
SCOPE = {
    "approximate_parametric_3d_not_vendor_step": ("model3d",), "no_confirmed_figures": ("figures",), "figure_evidence_missing": ("figures",),
    "package_field_evidence_unverified": GEOMETRY, "pin_field_evidence_unverified": PIN, "field_evidence_model_inference": GEOMETRY, "field_evidence_default_value": GEOMETRY,
    "required_output_missing": GEOMETRY, "default_value_used": GEOMETRY, "rule_or_jedec_derived": GEOMETRY, "geometry_auto_corrected": GEOMETRY,
    "land_pattern_derived_not_from_datasheet": GEOMETRY, "unsupported_package_family": GEOMETRY, "missing_required_geometry": GEOMETRY, "value_out_of_range_clamped": GEOMETRY,
    "geometry_transformation_applied": GEOMETRY, "pin_data_transformed_requires_review": PIN, "pin_count_or_number_conflict": PIN,
}
WARNINGS = [("rule_or_jedec_derived", "derived|nominal"), ("geometry_auto_corrected", "swapped|shrunk|discarded"), ("pin_count_or_number_conflict", "mismatch|duplicate|conflict"), ("missing_required_geometry", "blocked_missing_geometry"), ("unsupported_package_family", "not supported|symbol only")]


def evidence_anchor(anchors: DataFrame) -> DataFrame:
    """Anchors whose type needs a place but that lack document, page or (box or quote) become unverified."""
    kind = F.coalesce("source_type", F.lit("unverified"))
    placed = F.col("sha").isNotNull() & (F.col("page") >= 1) & (F.col("has_bbox") | (F.coalesce("quote", F.lit("")) != ""))
    down = kind.isin(*LOCATABLE) & ~F.coalesce(placed, F.lit(False))
    return anchors.select("owner_id", "field", F.when(down, "unverified").otherwise(kind).alias("source_type"), F.when(down, kind).alias("downgraded_from"))


def evidence_explode(provenance: DataFrame, pins: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """(owner_kind, owner_id, field, source_type): an anchor type for each field of packages, pins and figures.

    provenance: (package_id, field, source, page), pins: (package_id, number, page), figures: (figure_id, page). A value
    of the datasheet counts as drawn there only with its page.
    """
    source, page = F.col("source"), F.col("page").isNotNull()
    kind = F.when((source == "datasheet") & page, "datasheet_drawing").when(source == "reviewer", "reviewer").when(source == "missing", "default").otherwise("unverified")
    out = provenance.select(F.lit("package").alias("owner_kind"), F.col("package_id").cast("string").alias("owner_id"), "field", kind.alias("source_type"))
    if pins is not None:
        kind = F.when(page, "datasheet_table").otherwise("unverified")
        owner = F.concat_ws(":", F.col("package_id").cast("string"), "number")
        field = F.explode(F.array(*(F.lit(f"pin.{f}") for f in ("number", "name", "type", "description"))))
        out = out.union(pins.select(F.lit("pin"), owner, field, kind))
    if figures is not None:
        out = out.union(figures.select(F.lit("figure"), F.col("figure_id").cast("string"), F.lit("figure"), F.when(page, "datasheet_drawing").otherwise("unverified")))
    return out


def evidence_unbacked(anchors: DataFrame) -> DataFrame:
    """Fields of each owner with no anchor in the document."""
    backed = F.bool_or(F.col("source_type").isin(*LOCATABLE))
    out = anchors.groupBy("owner_id", "field").agg(backed.alias("backed")).where("not backed")
    return out.groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def gate_item(items: DataFrame, provenance: DataFrame, anchors: DataFrame, pins: DataFrame, figures: DataFrame, warnings: DataFrame) -> DataFrame:
    """(package_id, reason): every reason against promoting a package's assets, each once. What isn't told counts against.

    items: (package_id, mock, supported, valid, session, pins_review, transformed, land_source, land_reviewer, has_model3d,
    pin_count, has_pad, confirmed_figures, blocked, has_footprint, has_model_file); provenance: (package_id, field, source,
    reviewer, relevant); anchors: (package_id, field, source_type, reviewer); pins: (package_id, number, edited, anchored);
    figures: (package_id, confirmed, backed); warnings: (package_id, text).
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    derived, entered = F.col("land_source") == "derived_by_rules", F.col("land_source") == "reviewer_entered"
    files = ~said("blocked") & ~(said("has_footprint") & said("has_model_file"))
    told = [
        ("mock_data", said("mock")), ("unsupported_package_family", ~F.coalesce(F.col("supported"), F.lit(True))), ("validation_error", ~F.coalesce(F.col("valid"), F.lit(True))),
        ("no_authenticated_session", ~said("session")), ("pin_data_transformed_requires_review", F.coalesce(F.col("pins_review"), F.lit(True))),
        ("geometry_transformation_applied", said("transformed")), ("land_pattern_derived_not_from_datasheet", derived),
        ("reviewer_edit_without_provenance", entered & F.col("land_reviewer").isNull()), ("approximate_parametric_3d_not_vendor_step", said("has_model3d")),
        ("no_confirmed_figures", F.col("confirmed_figures") <= 0), ("missing_required_geometry", said("blocked")), ("required_output_missing", files),
    ]
    own = items.select("package_id", F.explode(F.array_compact(F.array(*(F.when(c, r) for r, c in told)))).alias("reason"))
    source, relevant = F.col("source"), said("relevant")
    field = (
        F.when((source == "reviewer") & F.col("reviewer").isNull(), "reviewer_edit_without_provenance")
        .when(source == "clamped", "value_out_of_range_clamped").when(source == "invalid", "validation_error")
        .when((source == "missing") & relevant, "missing_required_geometry").when((source == "default") & relevant, "default_value_used")
    )
    needed = provenance.where("relevant").select("package_id", "field").join(anchors, ["package_id", "field"], "left")
    kind = F.coalesce("source_type", F.lit("unverified"))
    evidence = (
        F.when((kind == "reviewer") & F.col("reviewer").isNull(), "reviewer_edit_without_provenance").when(kind == "model_inference", "field_evidence_model_inference")
        .when(kind == "default", "field_evidence_default_value").when(~kind.isin("reviewer", *LOCATABLE), "package_field_evidence_unverified")
    )
    n = pins.groupBy("package_id").agg(F.count("*").alias("n"), F.count_distinct("number").alias("different"))
    fits = (F.col("n") == F.col("pin_count")) | (said("has_pad") & (F.col("n") == F.col("pin_count") + 1))
    odd = (F.col("n") > F.col("different")) | (F.col("pin_count").isNotNull() & ~fits)
    rows = [
        own, provenance.select("package_id", field.alias("reason")), needed.select("package_id", evidence.alias("reason")),
        pins.where(said("edited") & ~said("anchored")).select("package_id", F.lit("pin_field_evidence_unverified").alias("reason")),
        items.select("package_id", "pin_count", "has_pad").join(n, "package_id").where(odd).select("package_id", F.lit("pin_count_or_number_conflict").alias("reason")),
        figures.where(said("confirmed") & ~said("backed")).select("package_id", F.lit("figure_evidence_missing").alias("reason")),
        gate_warning_map(warnings.select(F.col("package_id").alias("item_id"), "text")).select(F.col("item_id").alias("package_id"), "reason"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.where("reason is not null").distinct()


def gate_warning_map(warnings: DataFrame) -> DataFrame:
    """(item_id, text) -> the first reason whose words the text has."""
    from sheetgraph.functions.rx import first_of

    return warnings.select("item_id", first_of(F.col("text"), WARNINGS).alias("reason")).where("reason is not null").distinct()


def gate_scope(reasons: DataFrame) -> DataFrame:
    """(package_id, asset, reasons): which assets each package's reasons block; a reason without a scope blocks all."""
    scope = F.create_map(*[x for k, v in SCOPE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = reasons.select("package_id", "reason", F.explode(F.coalesce(F.try_element_at(scope, F.col("reason")), F.array(*map(F.lit, ASSETS)))).alias("asset"))
    return out.groupBy("package_id", "asset").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def gate_bundle(keys: DataFrame, scoped: DataFrame, own: DataFrame) -> DataFrame:
    """Verdict of each asset key (package_id, asset, key): its kind's reasons but missing figures, and its own."""
    shared = scoped.select("package_id", "asset", F.array_remove(F.split("reasons", ","), "figure_evidence_missing").alias("kind_reasons"))
    mine = own.groupBy("key").agg(F.collect_set("reason").alias("own_reasons"))
    out = keys.join(shared, ["package_id", "asset"], "left").join(mine, "key", "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union(F.coalesce("kind_reasons", none), F.coalesce("own_reasons", none)))
    return out.select("key", F.array_join(every, ",").alias("reasons"), (F.size(every) == 0).alias("promotable"))
