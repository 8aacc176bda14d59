"""Readings that feed the grid: every unit and spelling of the two devices."""

import datetime

import pytest

from pulsegrid.plans import reference

ROWS = [  # encounter, minute, value, device, unit
    ("a", 1.0, 70.0, "ART", "mmHg"), ("a", 2.0, 72.0, "ART", None), ("b", 1.0, 10.0, "NIBP", "kPa"), ("b", 2.0, 9.0, "NIBP", None), ("c", 1.0, 100.0, "ART", "cmH2O"),
    ("d", 1.0, 61.0, "A-line", "mmHg"), ("e", 1.0, 62.0, "cuff", None), ("f", 1.0, 63.0, "radial art line", "mmHg"), ("g", 1.0, 64.0, "DIRECT", "mmHg"), ("h", 1.0, 65.0, None, "mmHg"),
]
WANT = {
    ("a", 1.0, 70.0, "ART"), ("a", 2.0, 72.0, "ART"), ("b", 1.0, 75.006, "NIBP"), ("b", 2.0, 67.506, "NIBP"), ("c", 1.0, 73.556, "ART"), ("d", 1.0, 61.0, "ART"), ("e", 1.0, 62.0, "NIBP"), ("f", 1.0, 63.0, "ART"),
}


@pytest.fixture
def folder(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, "D", e, t, v, s, u, "MAP", at) for k, (e, t, v, s, u) in enumerate(ROWS)]
    spark.createDataFrame(rows, "obs_id bigint, dataset string, encounter_id string, minute_from_anesthesia_start double, map_value double, map_source string, raw_unit string, raw_display_name string, loaded_at timestamp").write.parquet(f"{tmp_path}/map_observations.parquet")
    labels = [(101, "map_source", "ART", "Invasive arterial line"), (102, "map_source", "NIBP", "Non-invasive cuff"), (103, "map_source", "DIRECT", "Charted directly, device not stated")]
    spark.createDataFrame(labels, "ref_id int, list_name string, canonical_name string, canonical_display string").write.parquet(f"{tmp_path}/label_reference.parquet")
    return str(tmp_path)


def test_every_unit_and_spelling_reaches_the_grid(spark, folder):
    assert {(r.case_id, r.t, round(r.map, 3), r.source) for r in reference.raw(spark, folder).collect()} == WANT
    cells = {r.case_id: r.map for r in reference.harmonize_h5(spark, folder).collect()}
    assert set(cells) == set("abcdef") and cells["a"] == 71.0
