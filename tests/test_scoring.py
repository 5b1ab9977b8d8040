"""An evaluation from files to its reports, and what makes it fail."""

import json

import pytest

from factmill.operators import scoring

NPI = "1234567890"


def case(ident, **gold):
    source = {"kind": "cms", "domain": "cms.gov", "capturedAt": "2026-01-01T00:00:00.000Z", "evidenceId": "e"}
    fact = lambda v: {"status": "confirmed_current", "displaySafe": True, "sources": [source]} | v
    return {
        "schemaVersion": 1, "caseId": ident, "request": {"npi": NPI, "name": "Dr. Jane Doe"}, "strata": {"entityType": "individual", "region": "r", "rurality": "rural", "specialtyGroup": "s", "edgeCases": []},
        "cmsBaseline": {"capturedAt": "2026-01-01T00:00:00.000Z", "providerId": "p", "name": "Jane Doe", "address": "1 Main Street"},
        "gold": {"identity": {"npi": NPI, "entityType": "individual"}} | {f: [fact(v) for v in gold.get(f, [])] for f in ("phones", "addresses", "websites", "ratings")},
    }


def observation(ident, repeat, **profile):
    made = {"npi": NPI, "providerName": "dr jane doe", "phoneNumbers": [{"value": "(216) 444-2200", "sourceId": "s"}], "locations": [{"addressLine1": "1 main st", "sourceId": "x"}], "sources": [{"id": "s", "domain": "clinic.org", "url": "https://clinic.org/"}]} | profile
    return {"schemaVersion": 1, "caseId": ident, "repeat": repeat, "latencyMs": 10 * repeat, "terminalStatus": "completed", "profile": made}


@pytest.fixture
def score(spark, tmp_path):
    def run(cases, observations, key=None):
        (tmp_path / "cases.jsonl").write_text("\n".join(map(json.dumps, cases)))
        for i, o in enumerate(observations):
            (tmp_path / f"o{i}.json").write_text(json.dumps(o, indent=1))
        (tmp_path / "manifest").write_text("\n".join(f"{tmp_path}/o{i}.json" for i in range(len(observations))) + "\n\n")
        scoring.score_files(spark, f"{tmp_path}/cases.jsonl", f"{tmp_path}/manifest", f"{tmp_path}/out", key)
        whole = lambda name: spark.read.option("multiLine", True).json(f"{tmp_path}/out/{name}").first().asDict(True)
        lines = lambda name: [r.asDict(True) for r in spark.read.json(f"{tmp_path}/out/{name}").collect()]
        return lines("case-scores"), whole("aggregate"), lines("repeat-variance/cases"), whole("repeat-variance/means")

    return run


def test_reports_of_an_evaluation(score):
    cases = [case("a", phones=[{"value": "216-444-2200"}]), case("b", phones=[{"value": "330-444-2200"}], ratings=[{"value": "4.8"}])]
    # The first of two repeats alone has a rating; the second case shows another provider.
    observations = [observation("a", 1, ratings=[{"value": "4.8/5", "sourceId": "none"}]), observation("a", 2), observation("b", 1, npi="0987654321")]
    scores, whole, variance, means = score(cases, observations)
    assert len(scores) == 3 and whole["cases"] == 3 and whole["max_latency_ms"] == 20
    assert (whole["identity_accuracy"], whole["wrong_provider_rate"], whole["failure_rate"], whole["address_agreement"]) == pytest.approx((2 / 3, 1 / 3, 0, 1))
    fields = {f["field"]: f for f in whole["fields"]}
    assert (fields["phones"]["emitted_precision"], fields["phones"]["top_one_accuracy"], fields["phones"]["citation_presence"]) == pytest.approx((2 / 3, 2 / 3, 1))
    assert fields["ratings"]["emitted_precision"] == fields["ratings"]["citation_presence"] == fields["ratings"]["coverage"] == 0
    assert [s["phones"]["top_one_correct"] for s in sorted(scores, key=lambda s: s["caseId"])] == [1, 1, 0]
    assert {v["caseId"]: v["mean_jaccard"] for v in variance} == pytest.approx({"a": 2 / 3, "b": 1})
    assert means["mean_jaccard"] == pytest.approx(5 / 6) and means["mean_top_one_agreement"] == pytest.approx(3 / 4)


def test_what_fails_an_evaluation(score):
    with pytest.raises(Exception, match="names no case: zzz"):
        score([case("a")], [observation("zzz", 1)])
    unsafe = case("a")
    unsafe["gold"]["phones"] = [{"valueHash": "0" * 64, "status": "unsafe_personal", "displaySafe": False, "sources": []}]
    with pytest.raises(Exception, match="a key is required"):
        score([unsafe], [observation("a", 1)])
