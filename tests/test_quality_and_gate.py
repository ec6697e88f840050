"""Quality, gate, provenance and figures on small made-up rows."""

from sheetgraph.operators import census, checks, cleaning, evidence, layout, quality
from sheetgraph.sources import records


def test_known_parts_and_their_pins(spark):
    """A part is known by its number, value or reference; the canonical map wins, extra pins lose confidence."""
    comps = spark.createDataFrame([(1, "U1", "x", "se-555"), (1, "MAX6106", "", None), (1, "U2", "NE555", "MCP3204"), (1, "U3", "other", None)], "design_id long, ref string, value string, mpn string")
    matched = quality.known_part_match(comps)
    assert {r["ref"]: r["part"] for r in matched.collect()} == {"U1": "NE555", "MAX6106": "MAX6106", "U2": "MCP3204"}
    pins = [("MAX6106", "1", "I N", "power_in", 50), ("MAX6106", "2", "GND", "power_in", 99), ("MAX6106", "9", "X", "input", 90)]
    df = spark.createDataFrame([(1, *p) for p in pins], "design_id long, ref string, number string, name string, type string, conf_pct long")
    rows = quality.known_pin_reconcile(matched.where("part = 'MAX6106'"), df)
    got = {r["number"]: (r["name"], r["type"], r["conf_pct"], r["result"]) for r in rows.collect()}
    assert got == {"1": ("IN", "power_in", 98, "kept"), "2": ("OUT", "power_out", 99, "corrected"), "3": ("GND", "power_in", 98, "added"), "9": ("X", "input", 40, "extra")}
    check = quality.known_pin_checks(rows).first()
    assert (check["compared"], check["mismatched"], check["missing"], check["extra"], check["accuracy"]) == (2, 1, 1, 1, 0.5)


def test_references_are_repaired_everywhere(spark):
    hints = spark.createDataFrame([(1, "U7", "MCP-3204", 0.9), (1, "R1", "4.7k", 0.9), (1, "U8", "NE555", 0.5), (1, "U9", "twice", 0.9)], "design_id long, ref string, value string, confidence double")
    comps = spark.createDataFrame([(1, "MCP3204", "", None), (1, "R1", "4.7k", None), (1, "X1", "NE555", None), (1, "A", "twice", None), (1, "B", "twice", None)], "design_id long, ref string, value string, mpn string")
    renames = quality.ref_reconcile(hints, comps)
    assert [(r["from_ref"], r["to_ref"]) for r in renames.collect()] == [("MCP3204", "U7")]
    ends = spark.createDataFrame([(1, 5, "MCP3204", "1"), (1, 5, "R1", "2"), (2, 5, "MCP3204", "1")], "design_id long, net_id long, ref string, pin string")
    assert sorted((r["design_id"], r["ref"], r["pin"]) for r in quality.ref_rename(ends, renames).collect()) == [(1, "R1", "2"), (1, "U7", "1"), (2, "MCP3204", "1")]


def test_every_reason_of_the_gate(spark):
    base = {"n_comps": 10, "n_nets": 10, "n_refs": 9, "components": 1.0, "n_labels": 5, "nets": 1.0, "compared": 8, "mismatched": 0, "missing": 0, "extra": 0, "conflicts": 0, "unresolved": 0, "renames": 0, "pins": 1.0, "graph": 1.0}
    cases = [
        ({}, "accepted", ""), ({"components": 0.5}, "rejected", "COMPONENT_COVERAGE_LOW"), ({"components": 0.4, "n_refs": 3}, "review", ""), ({"n_nets": 0}, "rejected", "VISIBLE_NETS_BUT_ZERO_RECONSTRUCTED"),
        ({"nets": 0.69}, "rejected", "NAMED_NET_COVERAGE_LOW"), ({"nets": None}, "accepted", ""), ({"conflicts": 1}, "rejected", "KNOWN_PINMAP_CONFLICT"), ({"unresolved": 1}, "rejected", "KNOWN_PINMAP_EXTRA_PINS"),
        ({"renames": 1}, "review", ""), ({"mismatched": 1}, "review", ""), ({"missing": 2}, "review", ""), ({"n_refs": 0, "n_labels": 0, "components": None, "nets": None, "pins": None, "graph": 0.89}, "review", ""),
        ({"n_refs": 0, "n_labels": 0, "components": None, "nets": None, "pins": None, "graph": 0.9}, "accepted", ""), ({"graph": 0.0, "pins": 0.2}, "review", ""),
    ]
    rows = [tuple((base | c)[k] for k in base) for c, _, _ in cases]
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in base.items())
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "design_id long, " + kinds)
    got = {r["design_id"]: (r["status"], r["reasons"], r["export_allowed"]) for r in quality.quality_gate(df).collect()}
    assert [got[i] for i in range(len(cases))] == [(s, r, s != "rejected") for _, s, r in cases]
    issues = {(r["design_id"], r["code"]) for r in quality.quality_issues(df).collect()}
    assert (6, "KNOWN_PINMAP_CONFLICT") not in issues and {(8, "REFERENCE_RECONCILED"), (9, "KNOWN_PINMAP_RECONCILED"), (7, "KNOWN_PINMAP_EXTRA_PINS")} <= issues


def test_the_gate_fails_closed(spark):
    """What is not told counts against a package; a package with everything told and backed has no reason."""
    item = "package_id long, mock boolean, supported boolean, valid boolean, session boolean, pins_review boolean, transformed boolean, land_source string, land_reviewer string, has_model3d boolean, pin_count long, has_pad boolean, confirmed_figures long, blocked boolean, has_footprint boolean, has_model_file boolean"
    good = (1, False, True, True, True, False, False, "datasheet", None, False, 2, False, 1, False, True, True)
    untold = (2, *[None] * 15)
    prov = [(1, "pitch", "datasheet", None, True), (1, "height", "missing", None, False), (2, "pitch", "reviewer", None, True), (2, "height", "invalid", None, False)]
    pins = [(1, "1", False, False), (1, "2", True, True), (2, "1", True, False), (2, "1", False, False)]
    make = lambda rows, s: spark.createDataFrame(rows, s)
    out = evidence.gate_item(
        make([good, untold], item), make(prov, "package_id long, field string, source string, reviewer string, relevant boolean"),
        make([(1, "pitch", "datasheet_table", None)], "package_id long, field string, source_type string, reviewer string"), make(pins, "package_id long, number string, edited boolean, anchored boolean"),
        make([(1, True, True), (2, True, False)], "package_id long, confirmed boolean, backed boolean"), make([(2, "rows swapped")], "package_id long, text string"),
    )
    got = {}
    for r in out.collect():
        got.setdefault(r["package_id"], set()).add(r["reason"])
    assert got == {2: {
        "no_authenticated_session", "pin_data_transformed_requires_review", "required_output_missing", "reviewer_edit_without_provenance", "validation_error", "package_field_evidence_unverified",
        "pin_field_evidence_unverified", "pin_count_or_number_conflict", "figure_evidence_missing", "geometry_auto_corrected",
    }}
    scoped = {(r["package_id"], r["asset"]): set(r["reasons"].split(",")) for r in evidence.gate_scope(out).collect()}
    assert "validation_error" in scoped[2, "figures"] and "figure_evidence_missing" not in scoped[2, "symbol"] and "package_field_evidence_unverified" not in scoped[2, "symbol"]


def test_provenance_of_reviewers(spark):
    nothing = {k: None for k in cleaning.FIELDS}
    rows = [(1, "qfn", *({**nothing, "pitch": 0.65, "height": float("nan")}).values()), (2, "dip", *({**nothing, "pitch": 99.0}).values())]
    df = spark.createDataFrame(rows, "package_id long, family string, " + ", ".join(f"{k} double" for k in cleaning.FIELDS))
    edits = spark.createDataFrame([(1, "body_length", 4.0, "ann"), (1, "body_width", 500.0, "ann"), (2, "row_span", 7.62, None)], "package_id long, field string, value double, reviewer string")
    out = cleaning.field_provenance(df, edits)
    got = {(r["package_id"], r["field"]): (r["source"], r["value"]) for r in out.collect()}
    assert got[1, "pitch"] == ("datasheet", 0.65) and got[1, "height"] == ("invalid", 1.0) and got[1, "body_length"] == ("reviewer", 4.0) and got[1, "body_width"] == ("clamped", 80.0)
    assert got[1, "lead_length"] == ("missing", 0.4) and got[1, "row_span"][0] == "not_applicable" and got[2, "pitch"] == ("clamped", 5.08) and got[2, "row_span"] == ("reviewer", 7.62)
    assert {r["package_id"]: r["fields"] for r in cleaning.critical_missing(out).collect()} == {1: "body_width,height,lead_length", 2: "body_length,body_width,height,pitch,row_span"}


def test_figures_of_headings(spark):
    """A heading in the upper part has its figure below, one in the lower part above, a caption above."""
    long = "x" * 70
    lines = [(0, 780.0, long), (1, 700.0, "Functional Block Diagram"), (2, 500.0, "Figure 1. Block Diagram"), (3, 480.0, long), (4, 200.0, "Simplified Schematic"), (5, 100.0, "end")]
    df = spark.createDataFrame([(1, 1, n, t, y) for n, y, t in lines], "doc_id long, page long, line_no long, text string, y double")
    got = {r["line_no"]: (round((1 - r["y0"]) * 792, 6), round((1 - r["y1"]) * 792, 6)) for r in layout.figure_region(df).collect()}
    assert got == {1: (700.0 - 3.6, 480.0 + 5.4), 2: (780.0 - 10.8, 500.0 - 14.4), 4: (480.0 - 10.8, 200.0 - 14.4)}


def test_part_info_of_links_and_pages(spark):
    lines = spark.createDataFrame([(1, 1, 0, "LM555 timer", 780.0), (1, 1, 1, "made by texas instruments", 20.0), (2, 1, 0, "ADM8829, ADM8828", 700.0)], "doc_id long, page long, line_no long, text string, y double")
    links = spark.createDataFrame([(1, "https://a.example/x/lm555-n.pdf?y"), (2, "https://a.example/x.pdf")], "doc_id long, url string")
    got = {r["doc_id"]: (r["mpn"], r["manufacturer"]) for r in layout.part_info(lines, links).collect()}
    assert got == {1: ("LM555-N", "texas instruments"), 2: ("ADM8829", "")}


def test_census_of_items(spark):
    lines = spark.createDataFrame([(1, "see r7 and C12x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " u3 "), (1, "U4 U5"), (1, "Q9A")], "doc_id long, text string")
    assert {r["ref"] for r in census.census_refs(lines, items).collect()} == {"R7", "C12X", "U3", "Q9A"}


def test_strict_texts(spark):
    rows = [(1, "LM555"), (2, "a\tb"), (3, "x" * 65), (4, "   "), (5, None)]
    got = {r["id"]: r["strict_error"] for r in records.text_safety(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {1: None, 2: "control", 3: "too_long", 4: "empty", 5: "empty"}


def test_health_with_the_gate(spark):
    """Issues per severity, what passed and the score."""
    issues = spark.createDataFrame([(1, "error"), (1, "warning"), (1, "warning"), (2, "review")], "design_id long, severity string")
    parts = spark.createDataFrame([(1,), (1,), (2,), (3,)], "design_id long")
    got = {r["design_id"]: (r["error"], r["warning"], r["review"], r["passed"], r["score"]) for r in checks.health_score(issues, parts, parts).collect()}
    assert got == {1: (1, 2, 0, 3, 70), 2: (0, 0, 1, 2, 98), 3: (0, 0, 0, 2, 100)}
