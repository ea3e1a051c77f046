import pytest
from pyspark.sql import functions as F

from corpusloom.config import IGNORE_LABEL, TokenIdentity, mlm_config
from corpusloom.functions import scalars
from corpusloom.functions import sql as FS
from corpusloom.operators import objectives as O
from corpusloom.registry import Registry


def test_names_are_given_once():
    kinds = Registry("objective")

    @kinds.register("double")
    def double(x, by=2):
        return by * x

    assert kinds.build("double", 4) == 8 and kinds.build("double", 4, by=3) == 12
    assert "double" in kinds and list(kinds) == ["double"] and len(kinds) == 1
    with pytest.raises(ValueError, match="already"):
        kinds.register("double")(double)
    with pytest.raises(KeyError, match="there are double"):
        kinds["triple"]


def test_users_can_register_an_objective(spark, identity):
    rows = spark.createDataFrame([(0, [5, 6])], "seq_idx bigint, input_ids array<int>")
    O.OBJECTIVES.register("plain")(lambda samples, config, by: samples.withColumn("labels", F.col("input_ids")))
    try:
        assert O.build("plain", rows, mlm_config(identity)).first()["labels"] == [5, 6]
    finally:
        del O.OBJECTIVES._entries["plain"]


@pytest.fixture
def functions(spark):
    FS.drop_functions(spark, prefix="t_")
    yield FS.create_functions(spark, prefix="t_")
    FS.drop_functions(spark, prefix="t_")


def test_sql_masks_equal_the_operator(spark, functions):
    identity = TokenIdentity(vocab_size=100, pad_id=0, cls_id=1, sep_id=2, mask_id=3)
    rows = [(i, [1, *range(4 + i, 40 + i), 2, 0]) for i in range(30)]
    samples = spark.createDataFrame(rows, "seq_idx bigint, input_ids array<int>")
    samples.createOrReplaceTempView("samples")
    for hash_fn, suffix in (("xxhash64", ""), ("md5", "_md5")):
        config = mlm_config(identity, probability=0.4, seed=8, epoch=2, hash_fn=hash_fn)
        expected = O.mlm(samples, config).select("seq_idx", "input_ids", "labels", "attention_mask")
        found = spark.sql(f"""
            SELECT seq_idx, t_hide(input_ids, c, 3) AS input_ids, t_labels_of(input_ids, c) AS labels,
              t_attention_mask(input_ids, 0) AS attention_mask
            FROM (SELECT *, t_mask_choice{suffix}(input_ids, 0, 1, 2, 0.4D, 8L, 2L, seq_idx) AS c FROM samples)""")
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
        # Put in place of the call, not called.
        assert "t_hide" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sql_scalars(spark, functions):
    row = spark.sql("""
        SELECT t_epoch_offset(6L, 512L, 4L) AS a, t_round_up(9L, 8L) AS b, t_num_sequences(100L, 30L, 32L) AS c,
          t_num_sequences(10L, 30L, 32L) AS d, t_perplexity(200D) AS e, t_shard_split(1L, 2L) AS f,
          t_special_mask(array(1, 9), 0, 1, 2) AS g, t_valid_labels(array(-100, 4)) AS h""").first()
    top = spark.range(1).select(scalars.perplexity(F.lit(200.0))).first()[0]
    assert tuple(row) == (256, 16, 2, 0, top, "val", [True, False], [4])
    assert IGNORE_LABEL == -100


def test_sql_names(spark, functions):
    with pytest.raises(Exception, match="(?i)already exists"):
        FS.create_functions(spark, "round_up", prefix="t_")
    with pytest.raises(KeyError, match="perplexity"):
        FS.create_functions(spark, "round_down")
    with pytest.raises(ValueError, match="already"):
        FS.define("round_up", "n BIGINT", "BIGINT", "n")
