"""Ordered ranks, joins as of a time, versioned tables, phrases, automata, prints, greedy edges, stage times, reminders."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import automata, flow, ordered, phrases, prints, records, reminders, stages
from siltstone.plans import engine
from siltstone.plans.registry import QUERIES, Tables
from siltstone.sources import versioned
from siltstone.streaming import events as streams
from siltstone.streaming.reminders import reminder_stream
from tests.conftest import SF


def test_ranks_sizes_and_sums_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "hot", "b"]), rng.randrange(40), i, rng.choice([None, 1, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, id long, v int").repartition(7)
    got = {r.id: (r["rank"], r["size"], r.s) for r in ordered.in_order(df, ["g"], [F.col("k").desc(), F.col("id").asc()], {"s": F.col("v")}).collect()}
    for g in (None, "hot", "b"):
        total = 0
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        for place, r in enumerate(own):
            assert got[r[2]] == (place, len(own), total)
            total += r[3] or 0
    assert ordered.in_order(df.limit(0), ["g"], [F.col("k").asc()]).count() == 0
    whole = {r.id: r["rank"] for r in ordered.in_order(df, [], [F.col("id").desc()]).collect()}
    assert whole == {i: 399 - i for i in range(400)}


def test_ranges_share_one_key(spark):
    """A table of one key: no range has more than twice the rows of the median one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit("one").alias("g"), "id")
        rows = df.repartitionByRange(F.col("g").asc_nulls_first(), F.col("id").asc()).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in rows)
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("strict", [False, True])
def test_join_as_of_by_brute_force(spark, strict):
    rng = random.Random(2)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(30)])) for i in range(150)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), rng.randrange(100)) for _ in range(60)]
    a = spark.createDataFrame(left, "id int, k string, t int").repartition(5)
    b = spark.createDataFrame(right, "k string, t int, v int").repartition(3)
    got = {r.id: r.v for r in ordered.as_of(a, b, ["k"], "t", ["v"], strict).collect()}
    for i, k, t in left:
        fit = [(x[1], x[2]) for x in right if x[0] == k and x[1] is not None and t is not None and (x[1] < t or (x[1] == t and not strict))]
        assert got[i] == (max(fit)[1] if fit else None), (i, k, t)


def outbox(spark, tmp_path, n=60):
    rows = [(i, "pending" if i % 3 else "sent", datetime(2024, 1, 1), None, None) for i in range(n)]
    table = versioned.VersionedTable(spark, str(tmp_path / "outbox"), ["id"], buckets=4)
    table.create(spark.createDataFrame(rows, "id long, status string, next_at timestamp, claimed_at timestamp, owner string"))
    return table


def test_the_loser_of_two_claimers_takes_what_is_left(spark, tmp_path, monkeypatch):
    table = outbox(spark, tmp_path)
    now = lambda m: F.lit(f"2024-01-01 00:{m:02d}:00").cast("timestamp")
    commit, between = versioned.VersionedTable.commit, []

    def late(self, rows, version, kept):
        if not between:  # another claimer commits the same version first
            between.append([r.id for r in versioned.claim(table, "first", now(1), 10, 5).collect()] if between.append(0) is None else None)
        commit(self, rows, version, kept)

    monkeypatch.setattr(versioned.VersionedTable, "commit", late)
    second = [r.id for r in versioned.claim(table, "second", now(1), 10, 5).collect()]
    first = between[1]
    assert len(first) == len(second) == 10 and not set(first) & set(second)
    owners = {r.id: r.owner for r in table.read().where("owner IS NOT NULL").collect()}
    assert owners == dict.fromkeys(first, "first") | dict.fromkeys(second, "second")
    assert table.version() == 3 and table.read(1).where("owner IS NOT NULL").count() == 0
    again = sorted(r.id for r in versioned.claim(table, "third", now(6), 10, 5).collect())
    assert again == sorted(first + second)[:10]


def test_a_version_that_is_there_is_a_conflict(spark, tmp_path):
    table = outbox(spark, tmp_path)
    with pytest.raises(versioned.Conflict):
        table.commit(table.read().limit(1), 1, {})
    assert table.version() == 1 and table.read().count() == 60


def test_notices_are_given_once_and_rows_can_go(spark, tmp_path):
    table = outbox(spark, tmp_path)
    due = spark.createDataFrame([(1,), (2,), (2,), (99,)], "id long")
    at = F.lit("2024-02-01").cast("timestamp")
    assert sorted(r.id for r in versioned.notify_once(table, due, "id", "claimed_at", at).collect()) == [1, 2]
    version = table.version()
    assert versioned.notify_once(table, due, "id", "claimed_at", at).count() == 0 and table.version() == version
    table.update(lambda rows: rows.limit(0), lambda rows: rows.where("status = 'sent'"))
    assert table.read().count() == 40 and table.read(1).count() == 60


def test_reconciling_books(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("a", "z", "3"), ("b", "w", "2"), ("b", "v", None), ("a", "u", None)], "book string, k string, h string")
    lines = spark.createDataFrame([("a", "x", "9"), ("a", "z", "3"), ("a", "n", "4"), ("a", "u", None)], "book string, k string, h string")
    got = sorted(map(str, (tuple(r) for r in records.reconcile(old, lines, "book", "k", "h").collect())))
    assert got == sorted(map(str, [("update", "x", "9"), ("delete", "y", "2"), ("same", "z", "3"), ("insert", "n", "4"), ("same", "u", None), ("orphan", None, "1")]))


def test_phrases_by_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "a", "of", "red", "tent", "pack", "x1"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "the the the the")]
    asked = [(k, [rng.choice(words) for _ in range(1 + k % 5)]) for k in range(40)] + [(40, ["the", "the"]), (41, ["nope", "the"]), (42, []), (43, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.col("doc_id") % 2)
    index = phrases.positional_index(df, "doc_id", "text", carry=("kind",))
    table = spark.createDataFrame(asked, "phrase long, words array<string>")
    got = {(r.phrase, r.doc_id): r.at for r in phrases.phrase_places(index, "doc_id", table).collect()}
    want = {}
    for k, w in asked:
        for i, t in docs:
            own = (t or "").split()
            at = [j for j in range(len(own) - len(w or []) + 1) if own[j : j + len(w or [])] == w]
            if w and at:
                want[k, i] = at
    assert got == want
    odd = phrases.phrase_hits(index, "doc_id", table, 3, only=F.col("kind") == 1).collect()
    assert odd and all(r.doc_id % 2 for r in odd) and {(r.phrase, r.doc_id): r.occurrences for r in odd}.items() <= {k: len(v) for k, v in want.items()}.items()
    assert phrases.phrase_hits(phrases.positional_index(df.limit(0), "doc_id", "text", carry=("kind",)), "doc_id", table).count() == 0


def test_aliases_of_any_number_in_one_pass(spark):
    """10^5 aliases find what `contains` finds, in about the time of 10^2."""
    rng = random.Random(4)
    letters = "abcde "
    texts = [(i, "".join(rng.choice(letters) for _ in range(300))) for i in range(40)] + [(40, None), (41, ""), (42, "山と​道 の tent")]
    many = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(110_000)}
    df = spark.createDataFrame(texts, "id long, t string")
    words = spark.createDataFrame([(w,) for w in many] + [(None,), ("",), ("山と道",)], "word string")
    took = []
    for some in (words.limit(100), words):
        began = time.time()
        found = automata.contains_words(df, "id", F.translate("t", "​", ""), some).collect()
        took.append(time.time() - began)
    got = {(r.id, r.word) for r in found}
    assert len(found) == len(got) and (42, "山と道") in got
    for i, t in texts[:3]:
        assert {w for k, w in got if k == i} == {w for w in many if w and w in t}
    assert took[1] < 10 * took[0] + 20


def test_aliases_in_several_passes_give_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The Springfield-ring of a kind"), (2, "And Wander packs, 山と道"), (3, None), (4, "")], "id int, t string")
    table = spark.createDataFrame([("r", "ring"), ("r", "field-ring"), ("w", "and wander"), ("k", "a Kind"), ("n", "zzz"), ("y", "山​と道"), ("e", "")], "brand string, alias string")
    one = sorted(map(tuple, automata.contains_alias(texts, "id", "t", table).collect()))
    assert one == [(1, "k", "a Kind"), (1, "r", "field-ring"), (2, "w", "and wander"), (2, "y", "山​と道")]
    monkeypatch.setattr(automata, "CHARACTERS", 9)
    assert sorted(map(tuple, automata.contains_alias(texts, "id", "t", table).collect())) == one
    assert automata.contains_alias(texts, "id", "t", table.limit(0)).count() == 0


def best_by_trying(run, words, unknown):
    best = None

    def go(i, score, path):
        nonlocal best
        if i == len(run):
            if best is None or (score, [e for _, e, _ in path]) > best[0]:
                best = (score, [e for _, e, _ in path]), path
            return
        for e in range(i + 1, len(run) + 1):
            if run[i:e] in words:
                go(e, score + words[run[i:e]], [*path, (i, e, True)])
        if words.get(run[i], unknown - 1) < unknown:
            go(i + 1, score + unknown, [*path, (i, i + 1, False)])

    go(0, 0, [])
    out = []
    for a, b, known in best[1]:
        if not known and out and not out[-1][2]:
            out[-1] = (out[-1][0], b, False)
        else:
            out.append((a, b, known))
    return out


def test_cuts_of_short_runs_by_trying_all():
    rng = random.Random(5)
    for _ in range(400):
        run = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): -rng.randrange(1, 20) for _ in range(6)}
        matches = [(i, i + len(w), s) for w, s in words.items() for i in range(len(run)) if run.startswith(w, i)]
        rng.shuffle(matches)
        assert automata.best_cut(run, matches, -9) == best_by_trying(run, words, -9)


def test_segments_of_texts_without_spaces(spark, monkeypatch):
    words = spark.createDataFrame([("山と道", 50.0), ("帐篷", 30.0), ("轻量", 20.0), ("轻量化", 40.0), ("推荐", 10.0), ("a b", 9.0), (None, 1.0), ("推荐", 3.0)], "word string, weight double")
    texts = spark.createDataFrame([(1, "轻量化帐篷推荐 by 山と道! XYZ9"), (2, None), (3, "")], "id int, t string")
    cut = lambda **k: {r.id: r.words for r in automata.segment(texts, "id", F.col("t"), words, **k).collect()}
    assert cut() == {1: ["轻量化", "帐篷", "推荐", "by", "山と道", "xyz9"], 2: None, 3: []}
    assert cut(search=True)[1][:2] == ["轻量", "轻量化"]
    assert automata.segment(texts, "id", F.col("t"), words.limit(0)).first().words == ["轻量化帐篷推荐", "by", "山と道", "xyz9"]
    monkeypatch.setattr(automata, "CHARACTERS", 3)
    with pytest.raises(ValueError):
        automata.segment(texts, "id", F.col("t"), words)


def test_words_of_documents_by_trying_all(spark):
    """The query on a small table: its words joined are its text, and none beats the best cut."""
    rows = QUERIES["o101_dictionary_words"](spark, SF)
    assert rows.count() == Tables(spark, SF).documents.count() and rows.where("n > 0").count() > 0


def greedy(edges, cap):
    count, out = {}, []
    for a, b, r in sorted(edges, key=lambda x: x[2]):
        if count.get(a, 0) < cap and count.get(b, 0) < cap:
            count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
            out.append((a, b, r))
    return sorted(out)


def test_greedy_edges_on_chains_stars_and_random_graphs(spark):
    chain = [(i, i + 1, i) for i in range(10_000)]
    star = [(0, i, (i * 7919) % 100_003) for i in range(1, 100_001)]
    rng = random.Random(6)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(500)})
    mixed = [(a, b, r) for r, (a, b) in enumerate(rng.sample(pairs, len(pairs)))]
    for edges, cap, last in ((chain, 1, 20_000), (star, 5, 20_000), (mixed, 3, 40), (mixed, 1, 0), (mixed, 5, 10**6), ([], 2, 10)):
        df = spark.createDataFrame(edges, "a long, b long, rank long")
        assert sorted(map(tuple, flow.capped_edges(df, cap, last).collect())) == greedy(edges, cap)


@pytest.mark.parametrize("bits", [0, 1, 6, 10])
def test_near_prints_by_brute_force(spark, bits):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(150):
        p = rng.choice(base)
        for _ in range(rng.randrange(0, 9)):
            p ^= 1 << rng.randrange(64)
        rows.append((i, p - (1 << 64) if p >> 63 else p))
    rows += [(200, None), (201, rows[0][1]), (5, rows[9][1])]
    pairs, members = prints.near_prints(spark.createDataFrame(rows, "id long, print long"), bits)
    first = {}
    for i, p in rows:
        if p is not None:
            first[p] = min(i, first.get(p, i))
    want = {}
    for p, i in first.items():
        for q, j in first.items():
            d = bin((p ^ q) & (1 << 64) - 1).count("1")
            if p != q and i < j and d <= bits:
                want[i, j] = min(d, want.get((i, j), 64))
    assert {(r.a, r.b): r.distance for r in pairs.collect()} == want
    assert sorted((r.id, r["first"]) for r in members.collect()) == sorted((i, first[p]) for i, p in rows if p is not None)


def test_prints_of_rows_compare_neighbours(spark):
    cells = [[(r * 9 + c) % 5 for c in range(9)] for r in range(8)]
    want = 0
    for row in cells:
        for x, y in zip(row[:-1], row[1:], strict=True):
            want = want << 1 | (x > y)
    got = spark.createDataFrame([([v for r in cells for v in r],)], "c array<int>").select(prints.row_print(F.col("c"))).first()[0]
    assert got & (1 << 64) - 1 == want
    text = "".join("e" * (i % 3) + "x" * (4 - i % 3) for i in range(72))
    counts = spark.createDataFrame([(text,)], "t string").select(prints.text_cells(F.col("t"), "e")).first()[0]
    assert counts == [i % 3 for i in range(72)]


def plain_stage_times(given, judged):
    out = {}
    for task in {g[0] for g in given}:
        last, output, n, work, hub, van = None, None, 0, 0, 0, 0
        gap = lambda a, b: max(0, int((b - a).total_seconds() // 60)) if b >= a else 0
        for _, i, kind, at in sorted((g for g in given if g[0] == task), key=lambda g: g[1]):
            if kind == "dispatch":
                last = at
                if output is not None:
                    hub, output = hub + gap(output, at), None
            elif kind != "supplement":
                n += 1
                if last is not None:
                    work += gap(last, at)
                output = previous = at
                for _, _, relayed, when in sorted(j for j in judged if j[1] == i):
                    if relayed:
                        van += gap(previous, when)
                    else:
                        hub += gap(previous, when)
                    previous = when
        out[task] = (n, work, hub, van, max(0, n - 1))
    return out


def test_stage_times_by_a_loop(spark):
    rng = random.Random(8)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(4000), seconds=rng.randrange(60))
    given = [(rng.randrange(6), i, rng.choice(["dispatch", "output", "output", "supplement"]), at()) for i in range(120)]
    outputs = [g[1] for g in given if g[2] == "output"]
    judged = [(1000 + i, rng.choice(outputs), rng.random() < 0.5, at()) for i in range(90)]
    got = stages.stage_times(spark.createDataFrame(given, "task int, id int, kind string, at timestamp"), spark.createDataFrame(judged, "id int, deliverable int, relayed boolean, at timestamp"))
    assert {r.task: (r.versions, r.work_min, r.hub_min, r.van_min, r.reworks) for r in got.collect()} == plain_stage_times(given, judged)


def test_every_threshold_of_a_sweep(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(12)]), rng.choice([0, 0, 1, None])) for _ in range(200)]
    got = {r.threshold: r for r in stages.threshold_sweep(spark.createDataFrame(rows, "s int, p int"), "s", "p").collect()}
    known = [(s, p) for s, p in rows if s is not None and p is not None]
    best = None
    for t in sorted({s for s, _ in known}):
        tp, fp = sum(p for s, p in known if s >= t), sum(1 - p for s, p in known if s >= t)
        recall, precision = tp / sum(p for _, p in known), tp / (tp + fp)
        f = round(5 * precision * recall / (4 * precision + recall), 9) if tp else 0
        assert (got[t].tp, got[t].fp, got[t].f) == (tp, fp, f)
        if best is None or f > best[0]:
            best = f, t
    assert [t for t, r in got.items() if r.best] == [best[1]]


LIMITS = reminders.Limits(90, 240, 2)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def replay(spark, folder, changes, cuts, **options):
    """Changes in parts by their time, each a run of the stream that goes on where the last one stopped."""
    out = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = changes.where((F.lit(True) if low is None else F.col("at") >= F.lit(low)) & (F.lit(True) if high is None else F.col("at") < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = streams.event_stream(spark, f"{folder}/in", changes.schema, 100)
        keep = lambda rows, _: out.extend(map(tuple, rows.select("task", "kind", F.unix_millis("since"), F.unix_millis("due")).collect()))
        streams.run_now(reminder_stream(stream, LIMITS, **options), f"{folder}/state", keep)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 2])
def test_reminders_of_the_stream_are_those_of_the_batch_once_each(spark, tmp_path, rocks, parts):
    changes = engine.changes(Tables(spark, SF)).where("task < 12")
    first, last = changes.agg(F.min("at"), F.max("at")).first()
    want = reminders.reminders(changes, F.lit(last - timedelta(minutes=10)), LIMITS).select("task", "kind", F.unix_millis("since"), F.unix_millis("due"))
    got = replay(spark, tmp_path, changes, [first + (last - first) / 2] * (parts - 1), horizon_hours=10**6)
    assert got == sorted(map(tuple, want.collect())) and len(got) == len(set(got)) > 50


def test_a_stream_that_was_down_doesnt_flood(spark, tmp_path, rocks):
    """A standstill from more than a day before the watermark gives nothing, a later one does."""
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0, "dispatched", None), (2, t0 + timedelta(hours=70), "dispatched", None), (3, t0 + timedelta(hours=80), "done", None)]
    changes = spark.createDataFrame(rows, "task long, at timestamp, status string, due_at timestamp")
    got = replay(spark, tmp_path, changes, [], horizon_hours=24)
    assert [(r[0], r[1]) for r in got] == [(2, "ack"), (2, "escalate")]
