import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.config import MaskConfig, SpanConfig, TokenIdentity, electra_config, mlm_config
from corpusloom.functions.scalars import epoch_offset, round_up, sequence_count
from corpusloom.operators import batches as B
from corpusloom.operators import objectives as O

IDS = TokenIdentity(vocab_size=100, pad_id=0, cls_id=1, sep_id=2, mask_id=3)


@pytest.fixture
def samples(spark):
    def make(rows, batch=0):
        data = [(i, batch, ids) for i, ids in enumerate(rows)]
        return spark.createDataFrame(data, "seq_idx bigint, batch_id int, input_ids array<int>")

    return make


def rows_of(df):
    return sorted(df.collect(), key=lambda r: r["seq_idx"])


def test_padding_and_attention(samples):
    found = rows_of(O.mlm(samples([[1, 10, 11, 12, 2], [1, 20, 2]]), mlm_config(IDS, 0.0), ["batch_id"]))
    assert [r["input_ids"] for r in found] == [[1, 10, 11, 12, 2, 0, 0, 0], [1, 20, 2, 0, 0, 0, 0, 0]]
    assert [r["attention_mask"] for r in found] == [[1] * 5 + [0] * 3, [1] * 3 + [0] * 5]
    assert all(r["labels"] == [-100] * 8 for r in found)


@pytest.mark.parametrize("multiple,length", [(1, 9), (8, 16), (5, 10)])
def test_pad_multiple(samples, multiple, length):
    config = mlm_config(IDS, 0.0, pad_to_multiple_of=multiple)
    found = rows_of(O.mlm(samples([list(range(10, 19)), [10]]), config, ["batch_id"]))
    assert [len(r["input_ids"]) for r in found] == [length, length]


def test_everything_chosen(samples):
    ids = [1, 10, 3, 12, 2, 0]
    row = rows_of(O.mlm(samples([ids]), mlm_config(IDS, 1.0)))[0]
    assert row["input_ids"] == [1, 3, 3, 3, 2, 0]
    assert row["labels"] == [-100, 10, 3, 12, -100, -100]
    assert row["attention_mask"] == [1, 1, 1, 1, 1, 0]


@pytest.mark.parametrize("hash_fn", ["xxhash64", "md5"])
def test_mask_rate_and_labels(samples, hash_fn):
    ids = [1, *[10 + i % 80 for i in range(80)], 2]
    found = rows_of(O.mlm(samples([ids] * 100), mlm_config(IDS, hash_fn=hash_fn)))
    chosen = 0
    for row in found:
        for x, y, label in zip(ids, row["input_ids"], row["labels"]):
            assert (y, label) in ((x, -100), (3, x))
            assert x > 2 or label == -100
        chosen += sum(label != -100 for label in row["labels"])
    assert 0.28 < chosen / 8000 < 0.32
    assert len({tuple(r["labels"]) for r in found}) == 100


def test_masks_follow_keys_only(samples):
    """The same whatever the batch and partition; other epochs and seeds give others."""
    ids = [list(range(10, 60))] * 6
    base = [r["labels"] for r in rows_of(O.mlm(samples(ids), mlm_config(IDS)))]
    again = [r["labels"] for r in rows_of(O.mlm(samples(ids, batch=3).repartition(5, F.hash("seq_idx")), mlm_config(IDS)))]
    assert base == again
    for config in (mlm_config(IDS, epoch=1), mlm_config(IDS, seed=1)):
        assert base != [r["labels"] for r in rows_of(O.mlm(samples(ids), config))]


def test_electra(samples):
    rows = [[1, *range(10, 50), 2], [1, 10, 2]]
    found = rows_of(O.electra(samples(rows), electra_config(IDS, 0.4), ["batch_id"]))
    for ids, row in zip(rows, found):
        assert row["input_ids"] == ids + [0] * (48 - len(ids))
        assert row["is_masked"] == [y != -100 for y in row["mlm_labels"]]
        assert row["masked_input_ids"] == [3 if m else x for x, m in zip(row["input_ids"], row["is_masked"])]
        assert all(y in (-100, x) for x, y in zip(row["input_ids"], row["mlm_labels"]))
    assert any(found[0]["is_masked"])


def test_probability_is_checked():
    with pytest.raises(ValueError):
        MaskConfig(IDS, 1.5)


def spans_config(**kw):
    return SpanConfig(IDS, sentinel_start_id=1000, **kw)


@pytest.mark.parametrize("mean", [1.0, 3.0])
@pytest.mark.parametrize("density", [0.0, 0.15, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("hash_fn", ["xxhash64", "md5"])
def test_sampled_spans(samples, density, mean, hash_fn):
    lengths = [0, 1, 6, 7, 20, 64, 512]
    rows = [list(range(10, 10 + n)) for n in lengths] * 3
    config = spans_config(noise_density=density, mean_span_length=mean, hash_fn=hash_fn)
    found = rows_of(O.sample_spans(samples(rows), config))
    for ids, row in zip(rows, found):
        n, budget = len(ids), int(len(ids) * density)
        assert sum(row["span_lengths"]) == budget
        assert all(x >= 1 for x in row["span_lengths"])
        if mean == 1.0:
            assert row["span_lengths"] == [1] * budget
        spans = [(s["start"], s["len"]) for s in row["spans"]]
        assert [length for _, length in spans] == row["span_lengths"][: len(spans)]
        end = 0
        for start, length in spans:
            assert end <= start and start + length <= n
            end = start + length
        if 0 < budget < n:
            assert len(spans) == len(row["span_lengths"])
        if budget >= n > 0:
            assert 1 <= len(spans) <= max(1, n // 3)


@pytest.mark.parametrize("density", [0.0, 0.15, 0.6, 1.0])
def test_input_and_target_restore_the_original(samples, density):
    rows = [list(range(10, 10 + n)) for n in (1, 7, 64, 512)]
    config = spans_config(noise_density=density, num_sentinels=10**6)
    found = rows_of(O.replace_spans(O.sample_spans(samples(rows), config), config))
    for ids, row in zip(rows, found):
        taken, current = {}, None
        for x in row["labels"]:
            if x >= 1000:
                current = taken.setdefault(x, [])
            else:
                current.append(x)
        restored = [y for x in row["input_ids"] for y in (taken[x] if x >= 1000 else [x])]
        assert restored == ids
        if int(len(ids) * density) == 0:
            assert (row["input_ids"], row["labels"]) == (ids, [1000])


def brute_place(size, budget, drawn, gaps):
    """One sequence, span by span."""
    lengths, left = [], budget
    for x in drawn:
        if left > 0:
            lengths.append(min(x, left))
            left -= lengths[-1]
    if size == 0 or not lengths:
        return lengths, []
    used = lengths[: max(1, size // 3)] if sum(lengths) >= size else lengths
    room = size - sum(used)
    if room <= 0:
        return lengths, [(0, min(used[0], size))]
    spans, at = [], 0
    for length, gap in zip(used, gaps):
        start = at + gap % max(1, room // (len(used) + 1))
        if start + length > size:
            break
        spans.append((start, length))
        at = start + length
    return lengths, spans


def test_spans_of_a_batch_are_those_of_each_sequence():
    """All branches: no budget, more than the sequence, no room, a span that doesn't fit."""
    rng = np.random.default_rng(5)
    sizes = np.concatenate(([0, 0, 1, 1, 2, 3], rng.integers(0, 60, 400)))
    budgets = np.concatenate(([0, 4, 0, 1, 2, 9], rng.integers(0, 70, 400)))
    drawn = [rng.geometric(rng.choice([1.0, 0.4, 0.05]), b) for b in budgets]
    gaps = [rng.integers(0, 2**32, b) for b in budgets]
    lengths, counts, start, length, number = O.place_batch(sizes, budgets, np.concatenate(drawn), np.concatenate(gaps))
    at, spot, branches = 0, 0, set()
    for size, budget, d, g, count, spans in zip(sizes, budgets, drawn, gaps, counts, number):
        wanted, placed = brute_place(size, budget, d, g)
        assert lengths[at : at + count].tolist() == wanted
        assert list(zip(start[spot : spot + spans], length[spot : spot + spans])) == placed
        branches.add((len(placed) < len(wanted), len(placed) == 1, sum(wanted) >= size))
        at, spot = at + count, spot + spans
    assert len(branches) > 4


def brute_emit(ids, spans, first, count):
    corrupted, target, at = [], [], 0
    for k, (start, length) in enumerate(spans):
        sentinel = first + k % count
        corrupted += ids[at:start] + [sentinel]
        target += [sentinel] + ids[start : start + length]
        at = start + length
    return corrupted + ids[at:], target or [first]


def test_given_spans(spark):
    """Touching spans, spans at both ends, more spans than sentinels, none at all."""
    ids = list(range(10, 330))
    cases = [[], [(0, 3), (3, 1), (318, 2)], [(i, 1) for i in range(0, 320, 2)], [(0, 320)], [(5, 100), (105, 100)]]
    df = spark.createDataFrame(
        [(i, ids, c) for i, c in enumerate(cases)],
        "seq_idx bigint, input_ids array<int>, spans array<struct<start:int,len:int>>",
    )
    found = rows_of(O.replace_spans(df, spans_config()))
    for case, row in zip(cases, found):
        assert (row["input_ids"], row["labels"]) == brute_emit(ids, case, 1000, 100)


def test_span_batch(samples):
    rows = [list(range(10, 10 + n)) for n in (3, 50, 100)]
    found = rows_of(O.span_corruption(samples(rows), spans_config(), ["batch_id"]))
    assert len({len(r["input_ids"]) for r in found}) == 1 == len({len(r["labels"]) for r in found})
    for row in found:
        assert len(row["input_ids"]) % 8 == 0 == len(row["labels"]) % 8
        assert row["attention_mask"] == [int(x != 0) for x in row["input_ids"]]
        assert row["decoder_attention_mask"] == [int(x != -100) for x in row["labels"]]
    assert found[0]["labels"][:2] == [1000, -100]


def test_sentinels_must_lie_outside_the_vocabulary():
    with pytest.raises(ValueError, match="vocabulary"):
        SpanConfig(TokenIdentity(50265))
    assert SpanConfig(TokenIdentity(50265), allow_sentinel_overlap=True).sentinel_start_id == 30000


def test_budget_uses_binary_fractions(spark):
    row = spark.createDataFrame([(list(range(100)),)], "ids array<int>").select(O.span_budget(F.col("ids"), 0.29)).first()
    assert row[0] == int(100 * 0.29) == 28


def test_objectives_by_name(samples):
    assert set(O.OBJECTIVES) == {"mlm", "electra", "span_corruption"}
    rows, config = samples([[10, 11, 2]]), mlm_config(TokenIdentity(100), seed=1)
    assert O.build("mlm", rows, config).collect() == O.mlm(rows, config).collect()
    with pytest.raises(KeyError, match="electra"):
        O.build("none", rows, config)


def test_collate_and_counts(samples):
    df = samples([[10, 11], [12, 2], [1, 0]]).withColumns(
        {"pos_in_batch": (F.lit(5) - F.col("seq_idx")).cast("int"), "labels": F.array(F.lit(-100), F.col("seq_idx").cast("int"))}
    )
    row = B.collate(df, ["seq_idx", "input_ids"], ["batch_id"]).first()
    assert row["seq_idx"] == [2, 1, 0] and row["input_ids"] == [[1, 0], [12, 2], [10, 11]]
    counts = B.mask_counts(df, IDS, ["batch_id"], "input_ids").first()
    assert (counts["num_masked"], counts["num_eligible"], counts["ratio"]) == (3, 3, 1.0)
    masks = rows_of(B.add_masks(df, IDS))[1]
    assert masks["special_mask"] == [False, True] and masks["attention_mask"] == [1, 1]


@pytest.mark.parametrize("length,phases", [(512, 4), (7, 3), (512, 3)])
def test_offsets_and_counts(spark, length, phases):
    df = spark.range(8).select("id", epoch_offset(F.col("id"), length, phases).alias("o"))
    for row in df.collect():
        assert row["o"] == row["id"] % phases * length // phases
    totals = spark.createDataFrame([(0,), (100,), (512,), (1600,)], "t bigint")
    for row in totals.select("t", sequence_count(F.col("t"), 128, 512).alias("n")).collect():
        assert row["n"] == max(row["t"] - 128, 0) // 512


def test_round_up(spark):
    cases = ((0, 8), (1, 8), (8, 8), (9, 8), (9, 1))
    row = spark.range(1).select(*[round_up(F.lit(n).cast("bigint"), m) for n, m in cases]).first()
    assert list(row) == [0, 8, 8, 16, 9]
