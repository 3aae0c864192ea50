import random

from pyspark.sql import functions as F

from tracequarry.functions.json_edits import shape, subtrees
from tracequarry.operators.alignment import CLAUSES, WRITES, Clause, align, claim_cover, path_coverage, prefix_pairs, readiness

LIMITS = {"bought": lambda s: s["bought"] >= 1, "seen_first": lambda s: s["seen"] >= s["clicks"], "few_errors": lambda s: s["errors"] <= 15}


def overlaps(a, b):
    return a.startswith(b) or b.startswith(a)


def one_by_one(steps, clause, holds):
    """The clause judged by walking the steps, and again without those of its witnesses."""

    def history(rows):
        state = dict.fromkeys(WRITES.values(), 0)
        yield 0, None, holds(state)
        for step, tool, _, _ in rows:
            if tool in WRITES:
                state[WRITES[tool]] += 1
            yield step, tool, holds(state)

    past = list(history(steps))
    begins, final = past[0][2], past[-1][2]
    broken = next((p for p in past[1:] if not p[2]), None)
    restored, maintained = bool(begins and broken and final), bool(begins and not broken and final)
    tools = set() if maintained else set(clause.witness_tools) - ({broken[1]} if restored else set())
    moves = lambda writes: any(overlaps(p, w) for p in clause.transition_paths for w in writes)
    witness = next((s for s, t, w, _ in steps if t in tools and moves(w)), None)
    last = max((s for s, _, w, _ in steps if moves(w)), default=0)
    reads = [s for s, _, w, r in steps if s > last and not w and all(any(overlaps(p, x) for x in r) for p in clause.evidence_paths)]
    necessary = maintained or not list(history([x for x in steps if x[1] not in tools]))[-1][2]
    errors = [c for c, bad in (("unsatisfied", not final), ("no_repair_witness", restored and not tools), ("no_transition", not maintained and witness is None), ("no_evidence", not reads), ("unnecessary_witness", not necessary)) if bad]
    mode = "restored_invariant" if restored else "maintained_invariant" if maintained else "outcome"
    return (clause.id, mode, broken[0] if restored else None, broken[1] if restored else None, witness, reads[-1] if reads else None, necessary, ",".join(errors))


def test_alignment_equals_a_walk_over_the_steps(spark):
    rng = random.Random(1)
    lone = Clause("lone", lambda s: s["seen"] >= s["clicks"], ["$state.seen"], ["$state.seen", "$state.clicks"], ["click"])
    clauses, limits = [*CLAUSES, lone], LIMITS | {"lone": LIMITS["seen_first"]}
    rows, expected = [], set()
    for e in range(120):
        kinds = rng.choice([["view", "click", "signup"], ["view", "view", "purchase", "signup"], ["error", "signup"], [*WRITES, "signup"]])
        steps = []
        for s in range(1, rng.randrange(2, 40)):
            tool = rng.choice(kinds)
            writes = [f"$state.{WRITES[tool]}"] if tool in WRITES else []
            reads = [] if writes else rng.sample(["$state.seen", "$state.clicks", "$state.bought", "$state"], rng.randrange(3))
            steps.append((s, tool, writes, reads))
        rows += [(e, *s) for s in steps]
        expected |= {(e, *one_by_one(steps, c, limits[c.id])) for c in clauses}
    df = spark.createDataFrame(rows, "episode_id long, step long, tool string, writes array<string>, reads array<string>")
    got = {tuple(r) for r in align(df, clauses, WRITES).collect()}
    assert got == expected
    assert {r[2] for r in got} == {"restored_invariant", "maintained_invariant", "outcome"}
    assert {c for r in got for c in r[-1].split(",")} >= {"unsatisfied", "no_repair_witness", "no_transition", "no_evidence", "unnecessary_witness"}
    assert align(df.limit(0), clauses, WRITES).count() == 0


def test_cover_names_every_sentence_left_out(spark):
    ddl = "id long, at long, span string"
    sentences = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x"), (3, 1, "y")], ddl)
    claims = spark.createDataFrame([(1, 1, "a"), (1, 2, "c"), (2, 1, "x"), (4, 1, "z")], ddl)
    got = {tuple(r) for r in claim_cover(sentences, claims).collect()}
    assert got == {(1, 3, 2, 2, "2", "", False), (2, 1, 1, None, "", "", True), (3, 1, 0, 1, "1", "", False), (4, 0, 1, 1, "", "1", False)}


def test_prefix_join_equals_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.randrange(5), "$" + "".join(rng.choice("ab.") for _ in range(rng.randrange(5)))) for _ in range(n)]
    left, right = make(60) + [(9, "$x")], make(60)
    a, b = (spark.createDataFrame(x, "id long, path string") for x in (left, right))
    assert {tuple(r) for r in prefix_pairs(a, b).collect()} == {(i, p, q) for i, p in left for j, q in right if i == j and overlaps(p, q)}
    got = {r.id: r for r in path_coverage(a, b).collect()}
    for i in {i for i, _ in left}:
        goals = {p for j, p in left if j == i}
        met = {p for p in goals if any(j == i and overlaps(p, q) for j, q in right)}
        assert (got[i].goals, got[i].covered, got[i].uncovered) == (len(goals), len(met), ",".join(sorted(goals - met)))


def test_readiness_equals_a_walk(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for e in range(60):
        shown, hidden, blind, asked = set(), [], [], set()
        steps = [(s, *rng.choice([(f"h{rng.randrange(6)}", None), (None, f"h{rng.randrange(6)}"), (None, None)])) for s in range(1, rng.randrange(2, 14))]
        for s, made, used in steps:
            if used and used not in asked:
                asked.add(used)
                hidden += [f"{used}@{s}"] if used not in shown else []
                blind += [f"{used}@{s}"] if not shown else []
            shown |= {made} - {None}
        unused = len(shown - asked)
        rows += [(e, *s) for s in steps]
        expected[e] = (",".join(sorted(hidden)), ",".join(sorted(blind)), unused, not hidden and not blind, not hidden and not blind and not unused)
    df = spark.createDataFrame(rows, "episode_id long, step long, produced string, consumed string")
    assert {r.episode_id: tuple(r)[1:] for r in readiness(df).collect()} == expected


def test_shapes_and_subtrees(spark):
    texts = ['{"b":1,"a":[true,null,"x","$s.a"]}', '{"a":[false,null,"yy","$s.a"],"b":2.5}', '{"a":[1],"b":{"c":1}}', None, "{"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = [r.s for r in df.select("id", shape(F.col("t")).alias("s")).orderBy("id").collect()]
    assert got[0] == got[1] == '{"a":["<bool>","<NoneType>","<string>","$s.a"],"b":"<number>"}' and got[2] != got[0] and got[3] is got[4] is None
    trees = {r.id: {x.path: x.digest for x in r.n} for r in df.select("id", subtrees(F.col("t")).alias("n")).collect()}
    assert trees[0]["/b"] != trees[1]["/b"] and set(trees[2]) == {"", "/a", "/b", "/b/c"} and trees[3] == {}
