import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from groundcover.plans.prefix import positions
from groundcover import config, session
from groundcover.operators import clean, coverage, gates, lookup, planner, serve
from groundcover.operators import corroborate as web
from groundcover.sources import publish as sinks
from groundcover.sources import versions
from groundcover.sources.tables import load_table
from groundcover.streaming import planner as stream

FACILITY = ("unique_id string, name string, nfhs_district_name string, nfhs_state_ut string, district_resolved boolean, coordinates_valid boolean, "
            "latitude double, longitude double, numberDoctors_clean int, capacity_clean int, doctors_reported boolean, capacity_reported boolean, "
            "yearEstablished_clean int, zip_clean long, description string, procedure string, equipment string, source_type_count int, "
            "affiliated_staff_presence boolean, custom_logo_presence boolean, number_of_facts_about_the_organization double")
EVIDENCE = ("unique_id string, capability string, evidence_status string, trust_score double, trust_score_pct int, field_source string, "
            "text_span string, confirm_message string")
BASE = dict(unique_id="f1", name="City Hospital", nfhs_district_name="Bangalore", nfhs_state_ut=" Karnataka ", district_resolved=True,
            coordinates_valid=True, latitude=12.97, longitude=77.59, numberDoctors_clean=42, capacity_clean=180, doctors_reported=False,
            capacity_reported=True, yearEstablished_clean=1990, zip_clean=560001, description="d", procedure=None, equipment=None,
            source_type_count=1, affiliated_staff_presence=None, custom_logo_presence=None, number_of_facts_about_the_organization=None)


def facilities(spark, *changes):
    return spark.createDataFrame([{**BASE, **c} for c in changes], FACILITY)


def evidence(spark, *data):
    return spark.createDataFrame([(u, c, s, p / 100, p, "description", " span ", "Confirm.") for u, c, s, p in data], EVIDENCE)


def test_record_masks_unreported_and_invalid(spark):
    good, bad, blank = serve.facility_record(facilities(
        spark, {}, {"unique_id": "f2", "coordinates_valid": False, "district_resolved": False},
        {"unique_id": "f3", "name": "", "coordinates_valid": None})).orderBy("unique_id").collect()
    assert good["location"].asDict() == {"state": "Karnataka", "district": "Bangalore", "city": None, "pin": "560001",
                                         "lat": 12.97, "lon": 77.59, "unresolved": False}
    assert (good["raw_fields"]["numberDoctors"], good["raw_fields"]["capacity"]) == (None, 180)
    assert (bad["location"]["lat"], bad["location"]["lon"], bad["location"]["unresolved"]) == (None, None, True)
    assert blank["name"] == "Unnamed facility" and blank["location"]["lat"] is None


def test_listing_and_detail(spark):
    fac = facilities(spark, {}, {"unique_id": "f2", "name": "A Clinic"}, {"unique_id": "f3", "nfhs_state_ut": "Goa"})
    ev = evidence(spark, ("f1", "ICU", "verified", 82), ("f1", "Emergency", "weak_signal", 40), ("f2", "icu ", "likely", 70))
    listed = serve.list_facilities(fac, ev, capability=" Icu", state="karnataka").collect()
    assert [r["unique_id"] for r in listed] == ["f2", "f1"]
    assert listed[1]["capability_evidence"][0]["text_span"] == "span"
    assert serve.list_facilities(fac, ev, limit=2).count() == 2
    assert serve.list_facilities(fac, ev, state="nowhere").count() == 0
    detail = serve.facility_detail(fac, ev, "f1", " icu").first()
    assert [e["capability"] for e in detail["capability_evidence"]] == ["Emergency", "ICU"]
    assert detail["viewed_capability"] == "ICU" and detail["crosscheck_eligible"]
    assert [f["rule"] for f in detail["validator_flags"]] == ["check_single_source_high_acuity", "check_low_legitimacy_signals"]
    assert not serve.facility_detail(fac, ev, "f1", "Emergency").first()["crosscheck_eligible"]
    assert serve.facility_detail(fac, ev, "f1", "Dental").first()["validator_flags"] is None
    assert serve.facility_detail(fac, ev, "missing").count() == 0


def test_coverage_precedence_and_spine(spark):
    fac = facilities(spark, {"unique_id": "a", "nfhs_district_name": " D1 "}, {"unique_id": "b", "nfhs_district_name": "D1"},
                     {"unique_id": "c", "nfhs_district_name": "D2"}, {"unique_id": "x", "nfhs_district_name": " "},
                     {"unique_id": "y", "district_resolved": False}, {"unique_id": "z", "nfhs_state_ut": None})
    ev = evidence(spark, ("a", "ICU", "weak_signal", 11), ("b", "ICU", "likely", 20), ("c", "NICU", "weak_signal", 30),
                  ("c", "ICU", "no_signal", 5), ("y", "ICU", "verified", 99))
    spine = spark.createDataFrame([("D1", "Karnataka"), ("D2", "Karnataka"), ("D3", "Karnataka")], "region_name string, state string")
    got = {(r["region_id"], r["capability_queried"]): (r["coverage_status"], r["facility_count"], r["avg_trust_score_pct"])
           for r in coverage.region_coverage(fac, ev, spine).collect()}
    assert got == {
        ("D1_Karnataka", "ICU"): ("verified_coverage", 2, 16), ("D1_Karnataka", "NICU"): ("no_facility", 2, 0),
        ("D2_Karnataka", "ICU"): ("no_facility", 1, 5), ("D2_Karnataka", "NICU"): ("weak_coverage", 1, 30),
        ("D3_Karnataka", "ICU"): ("no_data", 0, 0), ("D3_Karnataka", "NICU"): ("no_data", 0, 0)}
    assert coverage.region_coverage(fac, ev).count() == 4
    assert gates.incomplete_keys(fac, "district_resolved", ["nfhs_district_name", "nfhs_state_ut"]).first()[0] == 2
    empty = coverage.region_coverage(fac, ev).limit(0)
    assert coverage.coverage_kpis(empty).first()["avg_trust"] == 0
    assert coverage.list_coverage(empty, "ICU").count() == 0


def test_pick_lists_ignore_accents(spark):
    cov = spark.createDataFrame([("Kéral", "b"), ("Keral ", " A"), ("Kéral", "á"), ("Goa", "z"), ("Keral", " ")], "state string, region_name string")
    assert [r[0] for r in coverage.pick_list(cov, "region_name", "KERAL").collect()] == ["A", "á", "b"]


def test_same_named_regions(spark):
    cov = spark.createDataFrame([("D", "A", "ICU", 1), ("D", "B", "ICU", 2)], "region_name string, state string, capability_queried string, facility_count int")
    regions = spark.createDataFrame([("D", "A"), ("D", "B")], "region_name string, state string")
    by_state = coverage.enrich_boundaries(regions, cov).collect()
    assert sorted((r["state"], r["facility_count"]) for r in by_state) == [("A", 1), ("B", 2)]
    by_name = coverage.enrich_boundaries(regions.select("region_name").distinct(), cov, ["region_name"]).collect()
    assert [r["facility_count"] for r in by_name] == [2]


def _claims(spark):
    data = [("f1", 1, "North", 1.0, 2.0, "ICU", "verified", "90"), ("f1", 2, "South", 1.0, 2.0, "NICU", "likely", "70"),
            ("f1", 3, "South", 1.0, 2.0, "ICU", "Claimed-Only", "150"), ("f2", 4, "nörth", None, 2.0, "NICU", "odd", None),
            ("f3", 5, "North", 1.0, 2.0, None, "verified", "10")]
    df = spark.createDataFrame(data, "unique_id string, o int, district string, latitude double, longitude double, name string, status string, trust_score_pct string")
    df = df.withColumns({"trust_score": F.lit(0.255), "confidence_level": F.lit(""), "field_source": F.lit("x"), "text_span": F.lit(None).cast("string"),
                         "confirm_message": F.lit(None).cast("string")})
    return serve.normalize_claim(df)


def test_claims_and_merge(spark):
    claims = {r["o"]: (r["status"], r["trust_score_pct"], r["confidence_level"], r["evidence_type"]) for r in _claims(spark).collect()}
    assert claims == {1: ("verified", 90, "high", "corroborating"), 2: ("likely", 70, "medium", "claim"),
                      3: ("weak_signal", 100, "low", "claim"), 4: ("no_signal", 26, "low", "absence")}
    merged = serve.merge_facility_rows(_claims(spark), "o", ["district", "latitude", "longitude"], ["name", "status", "trust_score_pct"])
    got = {r["unique_id"]: (r["district"], [tuple(c) for c in r["claims"]]) for r in merged.collect()}
    assert got == {"f1": ("North", [("ICU", "weak_signal", 100), ("NICU", "likely", 70)]), "f2": ("nörth", [("NICU", "no_signal", 26)])}
    region = serve.region_facilities(merged, "NORTH ", "ICU").collect()
    assert [(r["unique_id"], r["status"]) for r in region] == [("f1", "weak_signal"), ("f2", "no_signal")]
    assert [r["unique_id"] for r in serve.region_facilities(merged, "north", "ICU", best_first=False).collect()] == ["f2", "f1"]
    assert serve.region_facilities(merged, "north", "ICU", status="no_signal").count() == 1
    assert [r["unique_id"] for r in serve.preview_markers(merged, "ICU", 72).collect()] == ["f1"]
    assert [r["unique_id"] for r in serve.preview_markers(merged, "ICU", 72, matched=["f2"]).collect()] == ["f2"]


def test_review_sample(spark):
    data = [(f"u{i}", c, s, i, "n", "c") for i in range(6) for c in ("ICU", "Maternity") for s in config.STATUSES]
    df = spark.createDataFrame(data + [("blank", "ICU", "verified", 100, " ", "c")],
                               "unique_id string, capability string, evidence_status string, trust_score_pct int, facility_name string, address_city string")
    got = [(r["evidence_status"], r["unique_id"], r["capability"]) for r in serve.review_sample(df).collect()]
    assert got == [(s, f"u{i}", "ICU") for s in config.STATUSES for i in (5, 4)]


@pytest.mark.parametrize("results, known, available, error, expected", [
    ([], [], True, None, ("no_digital_footprint", -0.1, None)),
    (["https://known.org/a", "https://NEW.org/b"], ["http://www.known.org"], True, None, ("independently_corroborated", 0.05, "https://NEW.org/b")),
    (["https://www.known.org/a"], ["http://known.org"], True, None, ("no_new_corroboration", 0.0, None)),
    (["nothing"], [], True, None, ("no_new_corroboration", 0.0, None)),
    ([], [], True, "timeout", ("error", None, None)),
    ([], [], False, None, ("unavailable", None, None)),
])
def test_corroboration(spark, results, known, available, error, expected):
    base = spark.createDataFrame([("City Hospital", "Pune", [(u,) for u in results], known, available, error)],
                                 "facility_name string, city string, results array<struct<url: string>>, known_urls array<string>, available boolean, error string")
    sources = base.withColumns({"facility_name": F.lit(" CITY hospital"), "city": F.lit("pune ")})
    out = web.corroborate(base.select("facility_name", "city", "available", "error"),
                          web.results_from_arrays(base), web.urls_from_arrays(sources)).first()
    assert (out["status"], out["confidence_adjustment"], out["corroborating_url"]) == expected


def _events(spark):
    day = dt.datetime(2024, 1, 1)
    def row(i, scenario, kind, facility=None, note=None, name=None):
        return (scenario, i, day + dt.timedelta(minutes=i), kind, name, facility, note)
    return spark.createDataFrame([
        row(0, "s1", "note", "f0", "too early"), row(1, "s1", "create", name="Plan"), row(2, "s1", "shortlist", "f2"),
        row(3, "s1", "shortlist", "f1"), row(4, "s1", "note", "f1", "hello"), row(5, "s1", "shortlist", "f2"),
        row(6, "s1", "note", "f1", ""), row(7, "ghost", "note", "f1", "ignored"), row(8, "s2", "create", name="x" * 121),
        row(9, "s3", "create", name="Later")],
        "scenario_id string, event_id long, ts timestamp_ntz, kind string, name string, facility_id string, note string")


def test_fold(spark):
    events = _events(spark)
    listed = planner.scenario_list(events).collect()
    assert [(r["scenario_id"], r["updated_at"].minute, r["notes"], r["shortlisted"]) for r in listed] == [("s3", 9, 0, 0), ("s1", 5, 1, 2)]
    items = [(r["section"], r["pos"], r["facility_id"], r["note"]) for r in planner.scenario_items(events).orderBy("section", "pos").collect()]
    assert items == [("note", 0, "f1", "hello"), ("shortlist", 0, "f2", None), ("shortlist", 1, "f1", None)]
    assert planner.scenario_record(events, "s1").count() == 3 and planner.scenario_record(events, "s3").count() == 1


def test_stream_equals_batch_in_any_order(spark, tmp_path, rows):
    events = _events(spark)
    source = str(tmp_path / "in")
    for part in (events.where("event_id >= 4"), events.where("event_id < 5")):  # late and repeated events
        part.coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.append_events(feed, str(tmp_path / "log"), str(tmp_path / "offsets"))
    log = stream.read_events(spark, str(tmp_path / "log"))
    assert rows(planner.scenario_items(log)) == rows(planner.scenario_items(events))
    assert rows(planner.scenario_list(log)) == rows(planner.scenario_list(events))


def _scenario_events(n, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        scenario, kind = f"s{rng.choice([0, 0, 0, *range(40)])}", rng.choice(["create", "note", "shortlist", "shortlist", "bad"])
        ts = start + dt.timedelta(minutes=rng.randrange(n // 2))
        out.append((scenario, i, ts, kind, f"name {i}", f"F{rng.randrange(9)}", f"note {i}"))
    return out


def test_every_batch_leaves_the_whole_fold(spark, tmp_path, rows):
    """Late, repeated and differing deliveries, a replayed batch, one that failed, and a second source."""
    kind = "scenario_id string, event_id long, ts timestamp, kind string, name string, facility_id string, note string"
    data = _scenario_events(400, 1)
    first, second, late = data[200:], data[100:260], data[:120]
    other = [(*r[:6], "another note") for r in data[40:60]]
    log = str(tmp_path / "log")
    seen = []
    for batch_id, (source, part) in enumerate([("a", first), ("a", second), ("b", late), ("b", other)]):
        batch = spark.createDataFrame(part, kind)
        assert stream.apply_events(batch, batch_id, log, source, buckets=7)
        assert not stream.apply_events(batch, batch_id, log, source, buckets=7)  # replayed
        seen += part
        kept = {}
        for row in sorted(seen):
            kept.setdefault((row[0], row[1]), row)
        events = spark.createDataFrame(list(kept.values()), kind)
        assert rows(stream.read_items(spark, log)) == rows(planner.scenario_items(events))
        assert rows(stream.read_scenarios(spark, log)) == rows(planner.scenario_list(events))
    assert rows(stream.read_events(spark, log), *events.columns) == rows(planner.valid_events(events), *events.columns)
    broken = spark.createDataFrame(data[:5], kind).withColumn("note", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        stream.apply_events(broken, 9, log, "b")
    assert rows(stream.read_items(spark, log)) == rows(planner.scenario_items(events))
    assert spark.read.parquet(f"{log}/rejected").select("event_id").distinct().count() == sum(r[3] == "bad" for r in data)


def test_a_batch_rewrites_only_what_it_touches(spark, tmp_path, rows):
    kind = "scenario_id string, event_id long, ts timestamp, kind string, name string, facility_id string, note string"
    data = _scenario_events(300, 2)
    log = str(tmp_path / "log")
    stream.apply_events(spark.createDataFrame(data, kind), 0, log, "a", buckets=16)
    before = versions.read_pointer(spark, log)[1]["folders"]
    more = [("s5", 1000, data[0][2], "note", None, "F1", "late note")]
    stream.apply_events(spark.createDataFrame(more, kind), 1, log, "a")
    after = versions.read_pointer(spark, log)[1]["folders"]
    assert sum(before[b] != after[b] for b in after) == 1
    events = spark.createDataFrame(data + more, kind)
    assert rows(stream.read_items(spark, log)) == rows(planner.scenario_items(events))
    one = stream.read_items(spark, log, "s5")
    assert rows(one) == rows(planner.scenario_items(events.where("scenario_id = 's5'")))
    assert len(one.inputFiles()) <= len(stream.read_items(spark, log).inputFiles()) / 4


def test_a_reader_always_finds_a_whole_version(spark, tmp_path):
    """Polled while other versions are published."""
    from threading import Thread

    path = str(tmp_path / "t")
    versions.publish_version(spark.range(1000).withColumn("v", F.lit(0)), path)
    seen, stop = [], []

    def poll():
        while not stop:
            seen.append(versions.read_version(spark, path).agg(F.count("*"), F.min("v"), F.max("v")).first())

    reader = Thread(target=poll)
    reader.start()
    for v in range(1, 6):
        versions.publish_version(versions.read_version(spark, path).withColumn("v", F.lit(v)), path, kept=4)
    stop.append(1)
    reader.join()
    assert len(seen) > 1 and all(n == 1000 and low == high for n, low, high in seen)
    with pytest.raises(Exception, match="no"):
        versions.publish_version(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert versions.read_version(spark, path).select(F.max("v")).first()[0] == 5
    with pytest.raises(RuntimeError, match="another writer"):
        versions.write_pointer(spark, path, versions.read_pointer(spark, path)[0], {})
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 4


def test_self_overwrite_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(spark.range(100), path)
    grown = spark.read.parquet(path).withColumn("extra", F.lit("x"))
    assert sinks.publish(grown, path).count() == 100
    assert spark.read.parquet(path).columns == ["id", "extra"]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(spark.range(100), path)
    broken = spark.range(10).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.publish(broken, path)
    assert spark.read.parquet(path).count() == 100
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_coverage_gates_and_cleanup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_written", {})  # other tests' tables stay
    rows = [(f"r{i}", c, s, 50) for i in range(4) for c, s in zip(config.CAPABILITY_QUERIES, [*config.COVERAGE_STATUSES, *config.COVERAGE_STATUSES])]
    df = spark.createDataFrame(rows, "region_id string, capability_queried string, coverage_status string, avg_trust_score_pct int")
    path = str(tmp_path / "c")
    assert sinks.publish_audited(df, path, sinks.coverage_gates(4)).count() == len(rows)
    for bad in (df.limit(5), df.withColumn("capability_queried", F.lit("ICU")), df.withColumn("coverage_status", F.lit("x")), df.withColumn("avg_trust_score_pct", F.lit(101))):
        with pytest.raises(gates.GateError):
            sinks.publish_audited(bad, path, sinks.coverage_gates(4))
    assert spark.read.parquet(path).count() == len(rows)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["c"]
    session.materialize(df, "kept")
    assert session.cleanup(spark) >= 1 and session.cleanup(spark) == 0


def test_staging_drops_its_tables_and_no_others(spark, tmp_path, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(session, "_written", {})
    before = session.materialize(spark.range(3), "before")
    home = Path(session.scratch_path(spark, "x")).parent
    here = {p.name for p in home.iterdir()}
    with session.staging(spark):
        outer = session.materialize(spark.range(4), "outer")
        with session.staging(spark):
            session.materialize(spark.range(5), "inner")
        assert {p.name.split("-")[0] for p in home.iterdir() if p.name not in here} == {"outer"}
        kept = sinks.publish(outer, str(tmp_path / "kept"))
    assert {p.name for p in home.iterdir()} == here
    assert kept.count() == 4 and before.count() == 3
    with pytest.raises(ValueError), session.staging(spark):
        session.materialize(spark.range(6), "lost")
        raise ValueError
    assert {p.name for p in home.iterdir()} == here
    session.cleanup(spark)


def test_scratch_is_gone_after_the_application(tmp_path):
    import subprocess
    import sys

    for end in ("", "; raise SystemExit(3)"):
        code = (
            "from groundcover.session import get_session, materialize; "
            f"spark = get_session('gone', 'local[1]', spark__checkpoint__dir={str(tmp_path)!r}, spark__ui__enabled='false'); "
            f"assert materialize(spark.range(5), 'five').count() == 5{end}"
        )
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120)
        assert done.returncode == (3 if end else 0), done.stderr[-2000:]
        for _ in range(100):  # the driver's JVM ends a little after Python
            if not (left := [p.name for p in tmp_path.iterdir() if p.name.startswith("groundcover-")]):
                break
            time.sleep(0.1)
        assert not left


def test_positions_in_groups_of_any_size(spark):
    rows = [(g, i * 7 % 101) for g, n in (("a", 100), ("b", 3), (None, 2)) for i in range(n)]
    got = positions(spark.createDataFrame(rows, "g string, v int"), ["v"], ["g"]).collect()
    for group in ("a", "b", None):
        values = sorted(v for g, v in rows if g == group)
        assert {(r["v"], r["position"]) for r in got if r["g"] == group} == {(v, i + 1) for i, v in enumerate(values)}
    assert positions(spark.createDataFrame([], "v int"), ["v"]).columns == ["v", "position"]


def test_rejected_events_are_kept(spark):
    kind = "scenario_id string, event_id long, ts timestamp, kind string, name string, facility_id string, note string"
    rows = [("s", 1, None, "create", "x" * 121, None, None), ("s", 2, None, "note", None, "f", ""), ("s", 3, None, "shortlist", None, None, None), ("s", 4, None, None, None, None, None), ("s", 5, None, "shortlist", None, "f", None)]
    events = spark.createDataFrame(rows, kind)
    got = {r["event_id"]: r["problem"] for r in planner.rejected_events(events).collect()}
    assert got == {1: "name length", 2: "note length", 3: "no facility", 4: "unknown kind"}
    assert planner.valid_events(events).count() == 1


def test_failed_gate_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "coverage_status string")
    with pytest.raises(gates.GateError):
        sinks.publish_audited(df, path, [gates.not_skewed])
    assert not (tmp_path / "t").exists()
    assert sinks.publish_audited(df.unionAll(df.where("coverage_status = 'b'")), path, [gates.not_skewed]).count() == 11


def test_clean_facilities_end_to_end(spark):
    text = {c: None for c in [*config.LIST_COLUMNS, *config.BOOLEAN_COLUMNS, *config.SIGNAL_COLUMNS]}
    raw = {**text, "unique_id": "f", "numberDoctors": "12.5", "capacity": "80", "yearEstablished": "NA", "latitude": 12.0, "longitude": None,
           "address_zipOrPostcode": "PIN 5600017", "source_types": '["a","a"]', "source_urls": "oops", "affiliated_staff_presence": "yes"}
    schema = ", ".join(f"{c} {'double' if c in ('latitude', 'longitude') else 'string'}" for c in raw)
    row = clean.clean_facilities(spark.createDataFrame([raw], schema)).first()
    assert (row["numberDoctors_clean"], row["doctors_reported"], row["capacity_clean"], row["capacity_reported"]) == (None, False, 80, True)
    assert (row["coordinates_valid"], row["zip_clean"], row["source_type_count"], row["source_url_count"]) == (None, 560001, 2, 0)
    assert round(row["richness_prior"], 6) == 0.55


def test_indicators_and_codes(spark):
    indicators = clean.clean_indicators(spark.createDataFrame([("New  Town", "Maharastra ", "(1.5)")], "district_name string, state_ut string, x_pct string")).first()
    assert (indicators["district_norm"], indicators["state_norm"], indicators["x_pct"], indicators["x_pct_low_confidence"]) == ("new town", "maharashtra", 1.5, True)
    directory = spark.createDataFrame(
        [(1, "B", "S", "10", "70"), (1, "A", "S", "NA", "NA"), (1, "B", "S", "20", "80"), (2, "Z", "S", "NA", "NA"), (2, "Y", "S", "NA", "NA"),
         (3, "Q", " na ", "1", "1")], "pincode long, district string, statename string, latitude string, longitude string")
    got = {r["pincode"]: (r["district_norm"], r["pin_centroid_lat"]) for r in lookup.code_lookup(directory).collect()}
    assert got == {1: ("b", 15.0), 2: ("y", None)}


def test_scan_prunes_columns(spark):
    df = load_table(spark, "/root/testdata/sf0.001", "lineitem").where("l_quantity > 40").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
