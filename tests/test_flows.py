"""Flow assembly against a packet loop, with small buckets and a hot pair of endpoints."""

import random
import statistics

import pytest

from flowgauge.operators.flows import assemble_flows
from flowgauge.operators.metrics import RUN  # noqa: F401

IDLE, ACTIVE = 50, 300


def loop(packets):
    """One pass over packets in time order."""
    live, done = {}, []
    for pid, ts, src, dst, port, size in sorted(packets, key=lambda p: (p[1], p[0])):
        a, b = (src, port), (dst, 80)
        key = (min(a, b), max(a, b))
        f = live.get(key)
        if f is None or ts - f["last"] > IDLE:
            f = {"start": ts, "last": ts, "cut": 0, "pk": []}
            live[key] = f
            done.append(f)
        elif (ts - f["start"]) // ACTIVE != f["cut"]:
            f = {"start": f["start"], "last": ts, "cut": (ts - f["start"]) // ACTIVE, "pk": []}
            live[key] = f
            done.append(f)
        f["last"] = ts
        f["pk"].append((pid, ts, src, size))
    out = {}
    for f in done:
        first = f["pk"][0]
        up = [p for p in f["pk"] if p[2] == first[2]]
        gaps = [b[1] - a[1] for a, b in zip(f["pk"], f["pk"][1:])]
        up_gaps = [b[1] - a[1] for a, b in zip(up, up[1:])]
        out[min(p[0] for p in f["pk"])] = (
            len(f["pk"]),
            sum(p[3] for p in f["pk"]),
            len(up),
            max(gaps, default=None),
            max(up_gaps, default=None),
            statistics.stdev([p[3] for p in f["pk"]]) if len(f["pk"]) > 1 else 0.0,
        )
    return out


@pytest.mark.parametrize("cell_ms", [None, 1, 17])
def test_flows_equal_a_loop(spark, cell_ms):
    rng = random.Random(4)
    packets, t = [], 0
    for i in range(1500):
        t += rng.choices([0, 1, 7, 60], [0.2, 0.5, 0.2, 0.1])[0]
        hot = rng.random() < 0.5
        src, dst = ("a", "b") if hot else (rng.choice("cde"), rng.choice("fg"))
        if rng.random() < 0.4:
            packets.append((i, t, src, dst, 1000, rng.randrange(40, 1500)))
        else:
            packets.append((i, t, src, dst, 1000 + (not hot) * rng.randrange(3), rng.randrange(40, 1500)))
    schema = "pkt_id bigint, ts_ms bigint, src string, dst string, sport int, size bigint, dport int"
    df = spark.createDataFrame([(*p[:5], p[5], 80) for p in packets], schema).repartition(6)
    flows = assemble_flows(df, ["src", "sport"], ["dst", "dport"], idle_ms=IDLE, active_ms=ACTIVE, cell_ms=cell_ms)
    got = {
        r["flow_id"]: (
            r["bidirectional_packets"],
            r["bidirectional_bytes"],
            r["src2dst_packets"],
            r["bidirectional_max_piat_ms"],
            r["src2dst_max_piat_ms"],
            r["bidirectional_stddev_ps"],
        )
        for r in flows.collect()
    }
    want = loop(packets)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:5] == want[k][:5]
        assert got[k][5] == pytest.approx(want[k][5])
