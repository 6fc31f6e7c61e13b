import __spark_entry__ as entry


def test_a16_counts_all_spans_and_captions(spark, tmp_path):
    said = "cls STRING, hand STRING, ap_trend STRING"
    spans = [
        (1, "x", "both", 0.0, 2.0, "tea", "LEFT", "flat"),
        (2, "y", "both", 4.0, 6.0, "tea", "LEFT", None),
        (3, "z", "both", 20.0, 22.0, "tea", "LEFT", "flat"),  # no caption near
        (4, "z", "both", 20.0, 22.0, "tea", "LEFT", "flat"),  # delivered again
        (5, "v", "spans", 0.0, 1.0, "tea", "LEFT", "flat"),
        (6, "w", "apart", 0.0, 1.0, "tea", "LEFT", "flat"),
    ]
    captions = [
        (1, "both", 0.0, 1.0, "tea", "left", "flat"),  # overlap 1/2, all fields
        (2, "both", 4.0, 6.0, "tea", "RIGHT", None),  # overlap 1, one field of three
        (3, "both", 50.0, 51.0, "tea", "LEFT", "flat"),
        (4, "both", 60.0, 60.0, "tea", "LEFT", "flat"),  # no interval
        (5, "captions", 0.0, 1.0, "tea", "LEFT", "flat"),
        (6, "apart", 5.0, 6.0, "tea", "LEFT", "flat"),
    ]
    spark.createDataFrame(spans, f"record_id BIGINT, span_id STRING, segment STRING, start_ts DOUBLE, end_ts DOUBLE, {said}").write.parquet(f"{tmp_path}/spans.parquet")
    spark.createDataFrame(captions, f"record_id BIGINT, segment STRING, start_ts DOUBLE, end_ts DOUBLE, {said}").write.parquet(f"{tmp_path}/baseline_vision.parquet")
    got = {r.segment: (round(r.precision, 9), round(r.recall, 9), round(r.f1, 9)) for r in entry.queries()["a16_monotone_alignment"](spark, str(tmp_path)).collect()}
    total = round((1 / 2 + 1 / 3) / 3, 9)
    assert got == {"both": (total, total, total), "spans": (0, 0, 0), "captions": (0, 0, 0), "apart": (0, 0, 0)}
