"""Operators without SQL, and state across batches, against plain Python."""

from loomspan.operators import folds, graph, knowledge, rank


def test_overlap_groups_grow_their_vocabulary(spark):
    sets = {1: "ab", 2: "bc", 3: "cd", 4: "xy", 5: "yz", 6: "q", 7: "d"}
    rows = [("day", i, e) for i, s in sets.items() for e in s]
    got = sorted(tuple(r) for r in knowledge.overlap_groups(spark.createDataFrame(rows, "day string, id long, entity string"), "day", shared=1, least=2).collect())
    assert got == [("day", 1, 1), ("day", 1, 2), ("day", 1, 3), ("day", 1, 7), ("day", 4, 4), ("day", 4, 5)]


def test_chain_survives_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "old long, new long")
    got = {(r.start, r.node, r.depth) for r in knowledge.chain(links).collect()}
    assert {x for x in got if x[0] == 1} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 3, -1), (1, 2, -2)}


def test_rollups_keep_incomplete_groups_out(spark):
    nodes = spark.createDataFrame([("s", i, i) for i in range(1, 22)], "session_id string, turn_start long, turn_end long")
    got = sorted((r.depth, r.turn_start, r.turn_end) for r in folds.rollups(nodes).collect())
    assert got == [(1, 4 * i + 1, 4 * i + 4) for i in range(5)] + [(2, 1, 16)]


def brute_labels(edges, rounds):
    label = {a: a for a, _, _ in edges}
    for _ in range(rounds):
        new = {}
        for n in label:
            votes = {}
            for a, b, w in edges:
                if a == n:
                    votes[label[b]] = round(votes.get(label[b], 0) + w, 9)
            new[n] = min(votes, key=lambda x: (-votes[x], x != label[n], x))
        label = new
    return label


def test_label_rounds_end_as_the_last_round_would(spark):
    pairs = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 0.5), ("e", "f", 1.0), ("d", "e", 0.1)]
    edges = pairs + [(b, a, w) for a, b, w in pairs]
    df = spark.createDataFrame(edges, "node string, other string, weight double")
    for rounds in (1, 2, 49, 50):
        assert {r.node: r.label for r in graph.propagate(df, rounds).collect()} == brute_labels(edges, rounds)


def test_search_for_all_terms_needs_each(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a a x"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a"), ("r", "nowhere"), ("s", "a")], "query_id string, term string")
    index = rank.inverted_index(docs, "id", "text", asked)
    assert sorted((r.query_id, r.rank, r.id) for r in rank.search(index, asked, 4).collect()) == [("q", 1, 1), ("q", 2, 2), ("s", 1, 3), ("s", 2, 1), ("s", 3, 2)]
