"""A line of every pack's source: which pack takes it, its class and activity, and what it says of addresses and users."""

import pytest

from emberlog.operators.packs import Registry
from emberlog.plans.library import library
from emberlog.plans.normalize import normalize
from emberlog.plans.vendors import LINES


@pytest.fixture(scope="module")
def events(spark):
    """The events of all lines, normalized together: (registry, a row for each line)."""
    registry = Registry(library())
    lines = [line.format(S="10.1.2.3", D="192.0.2.7", P=4321, U="u7") for line, *_ in LINES]
    made, dead = normalize(spark.createDataFrame([(x,) for x in lines], "raw string"), registry, now_ms=1_704_153_600_000)
    rows = {r["raw"]: r for r in made.collect()}
    assert len(rows) == len(LINES) and dead.count() == 0
    return registry, [rows[x] for x in lines]


@pytest.mark.parametrize("i", range(len(LINES)))
def test_pack(events, i):
    _, ref, kind, activity, has = LINES[i]
    got = events[1][i]
    assert got["pack"] == (None if ref == "fallback" else ref) and got["class_name"] == kind
    attrs = {k.removeprefix("evidences[0]."): v for k, v in got["attrs"].items()}
    assert got["errors"] == [] and got["activity_id"] == activity and attrs.get("src_endpoint.ip") == "10.1.2.3"
    assert (attrs.get("dst_endpoint.ip") == "192.0.2.7") == ("D" in has) and (attrs.get("src_endpoint.port") == "4321") == ("P" in has)
    assert (attrs.get("user.name") or attrs.get("actor.user.name")) == ("u7" if "U" in has else None)


def test_batches_use_what_is_compiled(spark, events):
    """A second batch with the same registry is built without compiling again, and a failing pack hands its line on."""
    registry = events[0]
    rules, stages = registry.compiled[0].rules(spark), dict(registry.compiled[1]._made)
    lines = [LINES[0][0].format(S="10.1.2.3", D="192.0.2.7", P=1, U="u"), "<14>x 1,2024/01/01 00:00:01,S1,TRAFFIC,", None, ""]
    got = normalize(spark.createDataFrame([(x,) for x in lines], "raw string"), registry, now_ms=0)[0].select("raw", "pack").collect()
    assert {r["raw"]: r["pack"] for r in got}[lines[0]] == "paloalto.panos@1.0" and len(got) == 2
    assert registry.compiled[0].rules(spark) is rules and all(registry.compiled[1]._made[k] is v for k, v in stages.items())
