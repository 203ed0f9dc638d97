from changeloom.operators import context


def test_calls_over_several_hosts_are_told_once_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(context, "HOST_BLOCK", 3)
    routes = [(f"h{i % 4}", "g", f"s{i % 9}") for i in range(30)] + [(None, "g", "s1")]
    calls = [(f"s{i % 11}", f"h{i % 5}") for i in range(60)] + [("s0", None)]
    found = context.topology(spark.createDataFrame(routes, "host string, from string, to string"), spark.createDataFrame([("s1", "t"), ("s1", "t"), ("t", "t")], "from string, to string"), spark.createDataFrame(calls, "from string, host string"))
    want = {("g", t, "route") for _, _, t in routes} | {("s1", "t", "uses")} | {(a, t, "calls") for a, h in calls for g, _, t in routes if h and h == g and a != t}
    got = [tuple(r) for r in found.select("from", "to", "kind").collect()]
    assert len(got) == len(want) and set(got) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].startswith("Union")
