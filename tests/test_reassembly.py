import random

from helpers import S, rows, span, spans

from spanlake.operators import reassembly, shape


def outcome(spark, *given):
    summaries, classes = reassembly.reassemble(spans(spark, *given))
    out = {
        (r.trace_id, r.window_start): (r.depth, r.span_count, r.root_service, r.incompleteness_reason, r.orphan_count)
        for r in summaries.collect()
    }
    return out, {(r.trace_id, r.span_id): r.classification for r in classes.collect()}


def test_chain_and_fan_out(spark):
    got, classes = outcome(
        spark,
        span("a", service="front"), span("b", "a"), span("c", "b"),
        span("r", trace="u", service="root"), span("x", "r", trace="u"), span("y", "r", trace="u"),
    )
    assert got[("t", 0)] == (3, 3, "front", "", 0)
    assert got[("u", 0)] == (2, 3, "root", "", 0)
    assert set(classes.values()) == {"ok"}


def test_orphan_and_its_descendants(spark):
    got, classes = outcome(spark, span("a"), span("b", "gone"), span("c", "b"), span("d", "c"))
    assert got[("t", 0)] == (1, 4, "svc", "orphan_missing_parent", 1)
    assert classes[("t", "b")] == "orphan_missing_parent"
    assert classes[("t", "c")] == classes[("t", "d")] == "ok"


def test_missing_and_multiple_roots(spark):
    got, _ = outcome(
        spark,
        span("b", "gone"),
        span("r1", trace="u", service="late", start=5), span("r2", trace="u", service="early", start=1),
        span("o", "gone", trace="u"), span("k", "r2", trace="u"),
    )
    assert got[("t", 0)] == (0, 1, "", "missing_root", 1)
    assert got[("u", 0)] == (2, 4, "early", "multiple_roots", 1)


def test_cycles_next_to_a_root_and_below_them(spark):
    got, classes = outcome(
        spark, span("r"), span("a", "b"), span("b", "a"), span("hang", "a"), span("self", "self"),
        span("p", "q", trace="u"), span("q", "p", trace="u"),
    )
    assert got[("t", 0)] == (1, 5, "svc", "cycle_rejected", 0)
    assert got[("u", 0)] == (0, 2, "", "missing_root", 0)
    assert {k for k, v in classes.items() if v == "cycle_rejected"} == {
        ("t", "a"), ("t", "b"), ("t", "hang"), ("t", "self"), ("u", "p"), ("u", "q"),
    }


def test_trace_straddling_two_windows(spark):
    got, classes = outcome(spark, span("a", start=59 * S), span("b", "a", start=61 * S))
    assert got[("t", 0)] == (1, 1, "svc", "", 0)
    assert got[("t", 60)] == (0, 1, "", "missing_root", 1)
    pairs = reassembly.resolved_pairs(spans(spark, span("a", start=59 * S), span("b", "a", start=61 * S)), False)
    assert pairs.count() == 1


def brute_force(parents):
    """Depth from the root or orphan each span hangs off; absent for cycles."""
    out = {}
    for node in parents:
        seen, at, depth = {node}, node, 0
        while parents[at] in parents and parents[at] != "":
            at = parents[at]
            depth += 1
            if at in seen:
                depth = None
                break
            seen.add(at)
        out[node] = depth
    return out


def test_random_graphs_shuffled_and_a_long_chain(spark):
    rng = random.Random(5)
    given, want, sizes = [], {}, {}
    for t in range(60):
        names = [f"s{i}" for i in range(rng.randint(1, 9))]
        parents = {n: rng.choice(["", "gone", *names]) for n in names}
        for n, d in brute_force(parents).items():
            want[(str(t), n)] = d
        given += [span(n, p, trace=str(t)) for n, p in parents.items()]
    chain = {f"c{i}": f"c{i - 1}" if i else "" for i in range(300)}
    given += [span(n, p, trace="long") for n, p in chain.items()]
    want |= {("long", f"c{i}"): i for i in range(300)}
    rng.shuffle(given)
    df = spans(spark, *given)
    got = {(r.trace_id, r.span_id): r.dist for r in reassembly.span_seeds(df).collect()}
    assert got == want
    counted = {(r.trace_id, r.span_id): (r.descendants, r.hidden_descendants) for r in shape.subtree_sizes(df).collect()}
    parent_of = {(s[0], s[1]): (s[0], s[2]) for s in given}
    for key in (k for k, d in want.items() if d is not None):
        sizes.setdefault(key, 0)
        up = parent_of[key]
        while up in want:
            sizes[up] = sizes.get(up, 0) + 1
            up = parent_of[up]
    assert {k: v[0] for k, v in counted.items()} == sizes
    assert counted[("long", "c8")] == (291, 291) and counted[("long", "c7")] == (292, 0)


def test_span_tree_flags(spark):
    df = spans(spark, span("r"), span("a", "r", start=61 * S), span("o", "gone"), span("k", "o"), span("z", "z"))
    assert rows(shape.span_tree(df), "span_id", "depth", "is_orphan", "in_orphan_subtree") == [
        ("a", 1, False, False), ("k", 1, False, True), ("o", 0, True, True), ("r", 0, False, False),
    ]


def test_span_fraction(spark):
    df = spans(
        spark, span("a", start=0, end=1000), span("b", "a", start=500, end=500),
        span("p", trace="flat", start=7, end=7),
    )
    assert rows(shape.span_fraction(df), "span_id", "left", "width") == [("a", 0.0, 1.0), ("b", 0.5, 0.001), ("p", 0.0, 1.0)]
