"""The operators as queries over the driver's tables.

Sizes are small next to real corpora so that the tables fill several windows,
shards and batches; every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.config import HEADER_BYTES, IGNORE_LABEL, LoaderConfig, SpanConfig, WindowConfig, electra_config, mlm_config
from corpusloom.functions import arrays, scalars
from corpusloom.functions import sql as FS
from corpusloom.operators import batches as B
from corpusloom.operators import metrics as M
from corpusloom.operators import objectives as O
from corpusloom.operators import order as R
from corpusloom.operators import pooling as P
from corpusloom.operators import shards as H
from corpusloom.operators import stream as S
from corpusloom.operators import subwords as SW
from corpusloom.operators import tokenize as T
from corpusloom.operators import vocab as V
from corpusloom.operators.bijection import Bijection
from corpusloom.plans import loading, pretokenize
from corpusloom.session import materialize, new_path
from corpusloom.sources import documents as D
from corpusloom.sources import shard_stream as SS
from corpusloom.sources import state as ST
from corpusloom.sources import token_shards as TS
from corpusloom.streaming.packing import IncrementalPacker

LENGTH = 128
SHARD_SIZE = 50_000
LONG_SHARD = 2_000_000
VAL_SHARDS = 2
CHUNK = 8192
SEED, EPOCH = 7, 3
# A public byte-level vocabulary and its id for the end of a text.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"
SUBWORD_SEPARATOR = 50256
PHASES = 4
BATCH = 32
MAX_DOCS = 100
STREAM_ROUNDS = 4
# Dimensions of the table's vectors.
VECTOR_DIMS = 64
# Scores per row where they come in blocks.
XENT_BLOCK = 12


class Tables:
    """Tables that several queries read, made once per session and input folder."""

    _made: dict[tuple[str, str], Tables] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, hash_fn: str = "md5") -> None:
        self.spark, self.sf_dir, self.hash_fn = spark, sf_dir, hash_fn

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Tables:
        """With md5 draws, which DuckDB can repeat."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._made:
            cls._made[key] = cls(spark, sf_dir)
        return cls._made[key]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return D.scan_documents(self.spark, f"{self.sf_dir}/documents.parquet")

    @cached_property
    def vocab(self) -> DataFrame:
        return materialize(V.build_vocab(self.documents), "vocab")

    @cached_property
    def identity(self):
        return V.identity_of(self.vocab)

    @cached_property
    def tokenize(self) -> Callable[[DataFrame], DataFrame]:
        return T.tokenizer(self.vocab)

    @cached_property
    def corpus(self) -> pretokenize.Corpus:
        return pretokenize.tokenize_corpus(self.documents, self.tokenize)

    def windows(self, epoch: int = 0, strategy: str = "fixed") -> DataFrame:
        offset = WindowConfig(LENGTH, strategy, PHASES).offset(epoch)
        return S.windows(self.corpus.pieces(), LENGTH, offset, epoch)

    def num_windows(self) -> int:
        return self.corpus.total_tokens // LENGTH

    def shard_pieces(self) -> DataFrame:
        return S.shard_pieces(self.corpus.pieces(), SHARD_SIZE, self.corpus.total_tokens, VAL_SHARDS)

    @cached_property
    def shard_folder(self) -> str:
        folder = new_path(self.spark, "shards")
        pretokenize.write_corpus(self.corpus, folder, self.identity, SHARD_SIZE, VAL_SHARDS)
        return folder

    def headers(self) -> DataFrame:
        return TS.read_headers(self.spark, self.shard_folder)

    def step_metrics(self) -> DataFrame:
        """Events as recorded steps: a user is a run; errors come without a number of positions."""
        positions = F.get_json_object("props", "$.k").cast("double")
        return self.read("events").select(
            F.col("user_id").alias("run"),
            F.col("event_id").alias("step"),
            F.sqrt("value").alias("loss"),
            F.when(F.col("event_type") != "error", positions).alias("num_masked"),
            "event_type",
        )


def text(ids: Column | str) -> Column:
    """An array as text, to compare it between engines."""
    return F.array_join((F.col(ids) if isinstance(ids, str) else ids).cast("array<string>"), ",")


def bits(flags: Column | str) -> Column:
    return F.array_join((F.col(flags) if isinstance(flags, str) else flags).cast("array<int>").cast("array<string>"), "")


# Scans and tokens


def document_scan(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length("text").alias("n_chars"))


def doc_cap(t: Tables) -> DataFrame:
    capped = D.scan_documents(t.spark, f"{t.sf_dir}/documents.parquet", max_docs=MAX_DOCS)
    return capped.select("doc_id", F.length("text").alias("n_chars"))


def build_vocab(t: Tables) -> DataFrame:
    return V.build_vocab(t.documents)


def tokenize_docs(t: Tables) -> DataFrame:
    return t.tokenize(t.documents).select("doc_id", "n", text("tokens").alias("tokens"))


def tokenize_turns(t: Tables) -> DataFrame:
    turns = t.read("conversations").withColumn("key", F.struct("conv_id", "turn"))
    found = T.tokenize(turns, t.vocab, key="key")
    return found.select("key.conv_id", "key.turn", "n", text("tokens").alias("tokens"))


def tokenize_joined(t: Tables) -> DataFrame:
    joined = T.tokenize_by_join(t.read("benchmark"), t.vocab, key="item_id")
    return joined.select("item_id", "n", text("tokens").alias("tokens"))


def token_range_guard(t: Tables) -> DataFrame:
    moved = t.corpus.doc_tokens.select("doc_id", F.transform("tokens", lambda x: x * 2 - 10).alias("tokens"))
    return T.range_violations(moved)


# The stream, its shards and windows


def stream_offsets(t: Tables) -> DataFrame:
    return t.corpus.pieces().select("doc_id", "start", "end")


def shard_cut(t: Tables) -> DataFrame:
    return t.shard_pieces().select("shard_index", "start", text("tokens").alias("tokens"))


def shard_names(t: Tables) -> DataFrame:
    return t.shard_pieces().select("shard_index", "split", "name", "shard_tokens").distinct()


def shard_headers(t: Tables) -> DataFrame:
    return t.headers().select("split", "shard_index", "name", "file_bytes", "header.*")


def split_totals(t: Tables) -> DataFrame:
    return H.split_totals(t.headers())


def shard_offsets(t: Tables) -> DataFrame:
    return H.shard_offsets(t.headers()).select("split", "shard_index", "token_start", "token_end")


def asof_position(t: Tables) -> DataFrame:
    whole = H.shard_offsets(t.headers().withColumn("split", F.lit("all")))
    starts = t.corpus.pieces().select("doc_id", F.col("start").alias("position"))
    return H.locate(starts, whole)


def asof_position_merged(t: Tables) -> DataFrame:
    """As above, with a catalog taken to be too large for one process."""
    whole = H.shard_offsets(t.headers().withColumn("split", F.lit("all")))
    starts = t.corpus.pieces().select("doc_id", F.col("start").alias("position"))
    return H.locate_merged(starts, whole)


def shard_roundtrip(t: Tables) -> DataFrame:
    chunks = TS.read_tokens(t.spark, t.shard_folder, chunkTokens=CHUNK)
    return chunks.select("split", "shard_index", "start", text("tokens").alias("tokens"))


def header_consistency(t: Tables) -> DataFrame:
    """Some headers are changed, so that there is something to find."""
    index = F.col("shard_index")
    changed = F.col("header").withField("vocab_size", F.col("header.vocab_size") + (index % 3 == 2).cast("int"))
    changed = changed.withField("pad_id", F.col("header.pad_id") + (index % 5 == 4).cast("int"))
    return H.inconsistent_headers(t.headers().withColumn("header", changed))


def vocab_check(t: Tables) -> DataFrame:
    other = replace(t.identity, mask_id=t.identity.mask_id - 1, cls_id=99)
    return H.compare_identity(t.headers(), other)


def _windows(windows: DataFrame) -> DataFrame:
    return windows.select("epoch", "seq_idx", text("input_ids").alias("input_ids"))


def shard_roundtrip_long(t: Tables) -> DataFrame:
    """Shards longer than any document."""
    folder = new_path(t.spark, "long-shards")
    placed = S.shards_in_one_shuffle(t.corpus.doc_tokens, LONG_SHARD, t.corpus.total_tokens)
    TS.write_shards(placed, folder, t.identity, placed=True)
    chunks = TS.read_tokens(t.spark, folder, chunkTokens=CHUNK)
    return chunks.select("split", "shard_index", "start", text("tokens").alias("tokens"))


def windows_fixed(t: Tables) -> DataFrame:
    return _windows(t.windows())


def windows_epoch_offset(t: Tables) -> DataFrame:
    return _windows(t.windows(EPOCH, "epoch_offset"))


def windows_from_shards(t: Tables) -> DataFrame:
    config = WindowConfig(LENGTH, "epoch_offset", PHASES)
    return _windows(TS.read_windows(t.spark, t.shard_folder, "train", config, EPOCH))


def windows_across_chunks(t: Tables) -> DataFrame:
    """From the validation shards' chunks, which the reader places in their split's stream."""
    chunks = TS.read_tokens(t.spark, t.shard_folder, "val", chunkTokens=CHUNK)
    placed = chunks.select(F.col("split_start").alias("start"), "tokens")
    return _windows(S.windows_from_chunks(placed, LENGTH))


def window_lookup(t: Tables) -> DataFrame:
    total = t.corpus.total_tokens
    return _windows(S.lookup_window(t.corpus.doc_tokens, t.num_windows() // 2, LENGTH, total))


def window_lookup_in_shards(t: Tables) -> DataFrame:
    found = loading.shard_window(t.spark, t.shard_folder, "val", WindowConfig(LENGTH), SHARD_SIZE // LENGTH)
    return _windows(found)


def seq_count(t: Tables) -> DataFrame:
    total = t.corpus.doc_tokens.agg(F.sum(F.col("n").cast("bigint")).alias("total"))
    epochs = total.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(7))))
    offset = scalars.epoch_offset(F.col("epoch"), LENGTH, PHASES)
    count = scalars.sequence_count(F.col("total"), F.col("offset"), LENGTH)
    return epochs.withColumn("offset", offset).select("epoch", "offset", count.alias("num_sequences"))


# Order


def _in_order(t: Tables) -> DataFrame:
    """The windows themselves in the epoch's order."""
    return R.permute(t.windows(EPOCH), t.num_windows(), SEED, EPOCH, t.hash_fn)


def _first_id() -> Column:
    """A window's first token: what moves along with its index."""
    return F.get("input_ids", F.lit(0)).alias("first_id")


def manifest_generations(t: Tables) -> DataFrame:
    """Shards of both generations of a folder that was written and then overwritten with shards of half the size."""
    folder = new_path(t.spark, "generations")
    for size in (SHARD_SIZE, SHARD_SIZE // 2):
        pretokenize.write_corpus(t.corpus, folder, t.identity, size, VAL_SHARDS, mode="overwrite")
    rows = TS.manifest_rows(t.spark, folder).where("generation > 0")
    damaged = TS.damaged_shards(t.spark, folder)
    intact = rows.join(damaged, "name", "left").where(F.col("problem").isNull())
    return intact.select("generation", "name", ((F.col("size") - HEADER_BYTES) / 2).cast("bigint").alias("tokens"))


def windows_stream(t: Tables) -> DataFrame:
    """Windows of a shard folder that grows while a stream reads it, in rounds with a restart after each."""
    folder, out, check = (new_path(t.spark, x) for x in ("growing", "streamed", "stream-check"))
    pieces = t.shard_pieces()
    shards = t.corpus.num_shards(SHARD_SIZE)
    step = -(-shards // STREAM_ROUNDS)
    for first in range(0, shards, step):
        TS.write_shards(pieces.where(F.col("shard_index").between(first, first + step - 1)), folder, t.identity)
        stream = SS.stream_windows(t.spark, folder, "train", WindowConfig(LENGTH), include_tail=first + step >= shards)
        query = stream.writeStream.format("parquet").option("checkpointLocation", check)
        query.trigger(availableNow=True).start(out).awaitTermination()
    rows = t.spark.read.schema(TS.SCHEMAS["windows"]).parquet(out)
    return rows.select("seq_idx", text("input_ids").alias("input_ids"))


def epoch_permutation(t: Tables) -> DataFrame:
    return _in_order(t).select("epoch", "seq_idx", "pos", _first_id())


def resume_tail(t: Tables) -> DataFrame:
    return R.resume(_in_order(t), t.num_windows() // 3).select("pos", "seq_idx", _first_id())


def rank_stripes_drop(t: Tables) -> DataFrame:
    stripes = R.rank_stripes(_in_order(t), t.num_windows(), 3, drop_last=True)
    return stripes.select("rank", "local_pos", "seq_idx", _first_id())


def rank_stripes_pad(t: Tables) -> DataFrame:
    stripes = R.rank_stripes(_in_order(t), t.num_windows(), 7, drop_last=False)
    return stripes.select("rank", "local_pos", "seq_idx", _first_id())


def batches_drop_last(t: Tables) -> DataFrame:
    return R.batches(_in_order(t), t.num_windows(), BATCH).select("batch_id", "pos_in_batch", "seq_idx", _first_id())


def loader_order(t: Tables) -> DataFrame:
    config = LoaderConfig(BATCH, drop_last=False, world_size=3)
    order = loading.arrange(_in_order(t), t.num_windows(), config, index=10)
    return order.select("rank", "batch_id", "pos_in_batch", "seq_idx", _first_id())


def _bijection(t: Tables) -> Bijection:
    return Bijection(t.num_windows(), SEED, EPOCH, t.hash_fn)


def keyed_permutation(t: Tables) -> DataFrame:
    """Every window's place in the keyed order, and the window that the order has there, which is the same one."""
    order = _bijection(t)
    placed = t.windows().withColumn("pos", order.position(F.col("seq_idx")))
    return placed.select("seq_idx", "pos", order.sample(F.col("pos")).alias("back"), _first_id())


def keyed_resume(t: Tables) -> DataFrame:
    """The last tenth of an epoch's masked batches, from shard files; the windows before it aren't read."""
    config = WindowConfig(LENGTH, "epoch_offset", PHASES)
    total = sum(s.token_count for s in TS.list_shards(TS.qualified(t.spark, t.shard_folder), "train"))
    index = loading.num_windows(total, config, EPOCH) * 9 // 10
    loader = LoaderConfig(BATCH, drop_last=False, order="keyed")
    found = loading.training_batches(
        t.spark, t.shard_folder, "train", "mlm", _mlm(t), config, loader, SEED, EPOCH, index
    )
    return found.select(
        "batch_id", "pos_in_batch", "seq_idx", text("input_ids").alias("input_ids"), text("labels").alias("labels")
    )


def state_resume(t: Tables) -> DataFrame:
    """Where each run goes on after its newest saved state: what is left of the epoch and the window that comes next."""
    name = F.concat(F.lit("step_"), F.col("event_id").cast("string"), F.lit(".pt"))
    index = F.pmod("event_id", F.lit(t.num_windows())).alias("pos")
    saved = t.read("events").select(F.col("user_id").alias("run"), name.alias("name"), index)
    newest = ST.latest_states(saved, ["run"]).join(saved, ["run", "name"])
    following = newest.join(_in_order(t), "pos")
    left = (F.lit(t.num_windows()) - F.col("pos")).cast("bigint").alias("num_left")
    return following.select("run", F.col("pos").alias("index"), left, "seq_idx", _first_id())


def latest_state(t: Tables) -> DataFrame:
    suffix = F.when(F.col("event_type") == "error", F.lit(".tmp")).otherwise(F.lit(".pt"))
    name = F.concat(F.lit("step_"), F.col("event_id").cast("string"), suffix)
    return ST.latest_states(t.read("events").select(F.col("user_id").alias("run"), name.alias("name")), ["run"])


# Batches and objectives


def _documents_in_batches(t: Tables) -> DataFrame:
    """Documents as sequences of different lengths."""
    tokens = t.corpus.doc_tokens
    return tokens.select(
        F.col("doc_id").alias("seq_idx"),
        scalars.idiv(F.col("doc_id"), BATCH).alias("batch_id"),
        F.pmod("doc_id", F.lit(BATCH)).cast("int").alias("pos_in_batch"),
        F.col("tokens").alias("input_ids"),
    )


def pad_batches(t: Tables) -> DataFrame:
    padded = B.pad_batches(_documents_in_batches(t), {"input_ids": t.identity.pad_id}, ["batch_id"])
    return padded.select("batch_id", "pos_in_batch", F.size("input_ids").alias("length"), text("input_ids").alias("input_ids"))


def padded_lengths(t: Tables) -> DataFrame:
    return B.padded_length(_documents_in_batches(t), "input_ids", ["batch_id"])


def batch_assembly(t: Tables) -> DataFrame:
    """Windows take their tokens along into the order, and are put into batches there."""
    ordered = R.permute(t.windows(), t.num_windows(), SEED, EPOCH, t.hash_fn)
    rows = B.collate(R.batches(ordered, t.num_windows(), BATCH), ["seq_idx", "input_ids"], ["batch_id"])
    return rows.select("batch_id", text("seq_idx").alias("seq_idx"), text(F.flatten("input_ids")).alias("input_ids"))


def attention_mask(t: Tables) -> DataFrame:
    padded = B.pad_batches(_documents_in_batches(t), {"input_ids": t.identity.pad_id}, ["batch_id"])
    mask = arrays.attention_mask(F.col("input_ids"), t.identity.pad_id)
    return padded.select("seq_idx", bits(mask).alias("attention_mask"))


def special_mask(t: Tables) -> DataFrame:
    mask = arrays.special_mask(F.col("input_ids"), t.identity)
    return t.windows().select("seq_idx", bits(mask).alias("special_mask"))


def _mlm(t: Tables):
    return mlm_config(t.identity, seed=SEED, epoch=EPOCH, hash_fn=t.hash_fn)


def mlm_mask(t: Tables) -> DataFrame:
    masked = O.mlm(t.windows(), _mlm(t))
    return masked.select(
        "seq_idx", text("input_ids").alias("input_ids"), bits("attention_mask").alias("attention_mask"),
        text("labels").alias("labels"),
    )


def mlm_sql(t: Tables) -> DataFrame:
    """Masked windows by SQL functions."""
    FS.drop_functions(t.spark, prefix="loom_")
    FS.create_functions(t.spark, prefix="loom_")
    t.windows().createOrReplaceTempView("loom_windows")
    i = t.identity
    return t.spark.sql(f"""
        SELECT seq_idx, array_join(loom_hide(input_ids, chosen, {i.mask_id}), ',') AS input_ids,
          array_join(loom_attention_mask(input_ids, {i.pad_id}), '') AS attention_mask,
          array_join(loom_labels_of(input_ids, chosen), ',') AS labels
        FROM (SELECT seq_idx, input_ids, loom_mask_choice_md5(input_ids, {i.pad_id}, {i.cls_id}, {i.sep_id}, 0.3D,
              {SEED}L, {EPOCH}L, seq_idx) AS chosen FROM loom_windows)""")


def state_roundtrip(t: Tables) -> DataFrame:
    """Windows that are left after the newest of three saved states, in ranked order."""
    store = ST.StateStore(t.spark, new_path(t.spark, "states"))
    count = t.num_windows()
    state = ST.SamplerState(SEED, count, EPOCH)
    for step in (9, 10, 100):
        state = state.advance(count // 5)
        store.save(step, state)
    _, found = store.load(SEED, count)
    return R.resume(_in_order(t), found.index).select("pos", "seq_idx", _first_id())


def subword_tokenize(t: Tables) -> DataFrame:
    """Documents as byte-pair tokens of a public vocabulary."""
    merges = SW.load_merges(TOKENIZER_FILE)
    found = SW.tokenize_subwords(t.documents, merges, separator=SUBWORD_SEPARATOR)
    return found.select("doc_id", "n", text("tokens").alias("tokens"))


def electra_inputs(t: Tables) -> DataFrame:
    masked = O.electra(t.windows(), electra_config(t.identity, seed=SEED, epoch=EPOCH, hash_fn=t.hash_fn))
    return masked.select(
        "seq_idx", text("input_ids").alias("input_ids"), text("masked_input_ids").alias("masked_input_ids"),
        bits("attention_mask").alias("attention_mask"), text("mlm_labels").alias("mlm_labels"),
        bits("is_masked").alias("is_masked"),
    )


def mask_counts(t: Tables) -> DataFrame:
    labels = O.masked_labels(F.col("input_ids"), F.col("seq_idx"), _mlm(t))
    labelled = t.windows().withColumns({"batch_id": scalars.idiv(F.col("seq_idx"), BATCH), "labels": labels})
    counted = B.mask_counts(labelled, t.identity, ["batch_id"], "input_ids")
    return counted.withColumn("ratio", F.round("ratio", 9))


def mlm_batches(t: Tables) -> DataFrame:
    """From shard files to masked batches in shuffled order."""
    config = WindowConfig(LENGTH, "epoch_offset", PHASES)
    found = loading.training_batches(
        t.spark, t.shard_folder, "train", "mlm", _mlm(t), config, LoaderConfig(BATCH), SEED, EPOCH
    )
    return found.select(
        "batch_id", "pos_in_batch", "seq_idx", text("input_ids").alias("input_ids"), text("labels").alias("labels")
    )


def _spans(t: Tables) -> SpanConfig:
    return SpanConfig(t.identity, sentinel_start_id=60000, seed=SEED, epoch=EPOCH, hash_fn=t.hash_fn)


def span_budget(t: Tables) -> DataFrame:
    budget = O.span_budget(F.col("tokens"), _spans(t).noise_density)
    return t.corpus.doc_tokens.select("doc_id", "n", budget.alias("budget"))


def span_emit(t: Tables) -> DataFrame:
    """Spans at the front, touching, and at the end of each window."""
    shift = F.pmod("seq_idx", F.lit(3)).cast("int")

    def span(start: Column, length: Column) -> Column:
        return F.struct(start.alias("start"), length.alias("len"))

    spans = F.array(
        span(shift, F.lit(3)), span(shift + 3, F.lit(1)), span(shift + 40, shift + 5), span(F.lit(LENGTH - 2), F.lit(2))
    )
    with_spans = t.windows().withColumn("spans", spans)
    emitted = O.replace_spans(with_spans, replace(_spans(t), num_sentinels=3))
    return emitted.select("seq_idx", text("input_ids").alias("input_ids"), text("labels").alias("labels"))


def span_sampling(t: Tables) -> DataFrame:
    sampled = O.sample_spans(t.windows(), _spans(t))
    return sampled.select(
        "seq_idx", text("span_lengths").alias("lengths"), text("spans.start").alias("starts"),
        text("spans.len").alias("used"),
    )


def span_corruption(t: Tables) -> DataFrame:
    samples = t.windows().withColumn("batch_id", scalars.idiv(F.col("seq_idx"), BATCH))
    found = O.span_corruption(samples, _spans(t), by=["batch_id"])
    return found.select(
        "seq_idx", text("input_ids").alias("input_ids"), bits("attention_mask").alias("attention_mask"),
        text("labels").alias("labels"), bits("decoder_attention_mask").alias("decoder_attention_mask"),
    )


def target_padding(t: Tables) -> DataFrame:
    """Documents as targets, padded with the ignored label."""
    targets = _documents_in_batches(t).withColumnRenamed("input_ids", "labels")
    padded = B.pad_batches(targets, {"labels": IGNORE_LABEL}, ["batch_id"])
    mask = arrays.label_mask(F.col("labels"))
    return padded.select("seq_idx", text("labels").alias("labels"), bits(mask).alias("decoder_attention_mask"))


def valid_labels(t: Tables) -> DataFrame:
    labels = O.masked_labels(F.col("input_ids"), F.col("seq_idx"), _mlm(t))
    return t.windows().select("seq_idx", text(arrays.valid_labels(labels)).alias("labels"))


# Metrics


def eval_summary(t: Tables) -> DataFrame:
    found = M.eval_summary(t.step_metrics(), ["run"])
    return found.select("run", F.round("eval_loss", 6).alias("eval_loss"), F.round("perplexity", 3).alias("perplexity"))


def _prior(t: Tables) -> DataFrame:
    """Sign-ups as the states saved before a resume: complete, without steps, without a sum."""
    signups = t.step_metrics().where("event_type = 'signup'")
    summed = signups.groupBy("run").agg(
        F.sum("loss").alias("loss_sum"), F.count("*").alias("loss_steps"), F.max("step").alias("global_step")
    )
    kind = F.pmod("run", F.lit(3))
    return summed.select(
        "run",
        F.when(kind != 2, F.col("loss_sum")).alias("loss_sum"),
        F.when(kind == 0, F.col("loss_steps")).alias("loss_steps"),
        "global_step",
    )


def train_summary(t: Tables) -> DataFrame:
    found = M.train_summary(t.step_metrics().where("event_type != 'signup'"), _prior(t))
    return found.select("run", "loss_steps", F.round("train_loss", 6).alias("train_loss"))


def running_loss(t: Tables) -> DataFrame:
    found = M.running_loss(t.step_metrics().select("run", "step", "loss"))
    return found.select("run", "step", F.round("mean_loss", 6).alias("mean_loss"))


def log_cadence(t: Tables) -> DataFrame:
    due = M.logged_steps(t.step_metrics(), 10)
    return due.select("run", "step", scalars.step_line(F.col("step"), F.col("loss")).alias("line"))


def eval_cadence(t: Tables) -> DataFrame:
    due = M.due_steps(t.step_metrics(), 25)
    return due.select("run", "step", F.round(scalars.perplexity(F.col("loss")), 3).alias("perplexity"))


def masked_xent(t: Tables) -> DataFrame:
    """Vectors as scores over their dimensions, their labels as the ids to predict."""
    batch = scalars.idiv(F.col("vec_id"), BATCH)
    ignored = (F.col("vec_id") % 3 == 0) | (F.col("batch") % 5 == 0)
    label = F.when(ignored, F.lit(IGNORE_LABEL)).otherwise(F.col("label"))
    scored = t.read("embeddings").withColumn("batch", batch)
    scored = scored.select("batch", F.col("embedding").alias("logits"), label.alias("label"))
    found = M.masked_cross_entropy(scored, ["batch"])
    return found.select("batch", F.round("loss", 6).alias("loss"), "num_masked")


def masked_xent_blocks(t: Tables) -> DataFrame:
    """As above, with each vector's scores in blocks of their own rows."""
    batch = scalars.idiv(F.col("vec_id"), BATCH)
    ignored = (F.col("vec_id") % 3 == 0) | (batch % 5 == 0)
    label = F.when(ignored, F.lit(IGNORE_LABEL)).otherwise(F.col("label"))
    first = F.explode(F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(XENT_BLOCK)))
    blocks = t.read("embeddings").select(batch.alias("batch"), F.col("vec_id").alias("pos"), label.alias("label"), "embedding", first.alias("first"))
    blocks = blocks.withColumn("logits", F.slice("embedding", F.col("first") + 1, F.lit(XENT_BLOCK))).drop("embedding")
    found = M.masked_cross_entropy_blocks(blocks, ["batch"])
    return found.select("batch", F.round("loss", 6).alias("loss"), "num_masked")


# Vectors


def _token_vectors(t: Tables) -> DataFrame:
    """Every token gets one of the table's vectors."""
    vectors = t.read("embeddings")
    count = vectors.count()
    tokens = t.spark.range(t.identity.vocab_size).withColumn("vec_id", F.col("id") % count)
    joined = tokens.join(vectors, "vec_id")
    return joined.select(F.col("id").cast("int").alias("token_id"), F.col("embedding").alias("vec"))


def token_vector_lookup(t: Tables) -> DataFrame:
    found = P.lookup_vectors(t.windows(), _token_vectors(t))
    return _vectors(found)


def token_vector_lookup_joined(t: Tables) -> DataFrame:
    """As above, with vectors taken to be too large to be sent to every task."""
    return _vectors(P.lookup_vectors(t.windows(), _token_vectors(t), max_broadcast_bytes=0))


@F.arrow_udf(DoubleType())
def _mixed(vectors: pa.Array) -> pa.Array:
    """Sums of i x the i-th of the first dimensions, in their order; null where one is null or missing.

    As one Spark expression its method is too long for the JVM to compile, which took 40 us a row.
    """
    rows = len(vectors)
    # Absent and short vectors take part with zeros and come out as null.
    begins, sizes = vectors.offsets.to_numpy()[:-1].astype(np.int64), pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    missing = sizes < VECTOR_DIMS
    at = np.where(missing, 0, begins)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    absent = pc.is_null(vectors.values).to_numpy(zero_copy_only=False) if vectors.values.null_count else None
    mixed = np.zeros(rows)
    for i in range(VECTOR_DIMS if len(values) else 0):
        place = np.minimum(at + i, len(values) - 1)
        mixed += (i + 1) * values[place]
        if absent is not None:
            missing = missing | absent[place]
    return pa.array(mixed, mask=missing)


def _vectors(found: DataFrame) -> DataFrame:
    """One number that every dimension has a part in, so that the whole vector is compared."""
    return found.select("seq_idx", "pos", "token_id", F.round(_mixed("vec"), 6).alias("vec_mix"))


def _pooled(pooled: DataFrame, key: str) -> DataFrame:
    flat = pooled.select(key, F.posexplode("pooled").alias("dim", "value"))
    return flat.withColumn("value", F.round("value", 6))


def masked_mean_pool(t: Tables) -> DataFrame:
    """Documents padded per batch, so that the mask matters."""
    padded = B.pad_batches(_documents_in_batches(t), {"input_ids": t.identity.pad_id}, ["batch_id"])
    return _pooled(P.embed_sequences(padded, _token_vectors(t), t.identity.pad_id), "seq_idx")


def embed_joined(t: Tables) -> DataFrame:
    """As above, with vectors taken to be too large to be sent to every task."""
    padded = B.pad_batches(_documents_in_batches(t), {"input_ids": t.identity.pad_id}, ["batch_id"])
    found = P.embed_sequences(padded, _token_vectors(t), t.identity.pad_id, max_broadcast_bytes=0)
    return _pooled(found, "seq_idx")


def masked_mean_pool_states(t: Tables) -> DataFrame:
    """Vectors as states of the sequence that their label names; every third position is masked out."""
    states = t.read("embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return _pooled(P.masked_mean_pool(states, "label", "embedding"), "label")


def mean_pool(t: Tables) -> DataFrame:
    return _pooled(P.mean_pool(t.read("embeddings"), "label", "embedding"), "label")


# Streaming


def incremental_packing(t: Tables) -> DataFrame:
    """Documents arrive in several files; the shards must be those of the whole."""
    spark, folder = t.spark, new_path(t.spark, "arriving")
    low, high = t.documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = (high - low) // STREAM_ROUNDS + 1
    out = new_path(spark, "stream")
    packer = IncrementalPacker(out, t.tokenize, t.identity, SHARD_SIZE, VAL_SHARDS)
    # Each round finds the files that came since the last.
    for i in range(STREAM_ROUNDS):
        part = t.documents.where(F.col("doc_id").between(low + i * step, low + (i + 1) * step - 1))
        part.write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(t.documents.schema).parquet(folder)
        packer.start(arriving, f"{out}/checkpoint").awaitTermination()
    packer.flush(spark)
    chunks = TS.read_tokens(spark, packer.shard_dir, chunkTokens=CHUNK)
    return chunks.select("split", "shard_index", "start", text("tokens").alias("tokens"))


ALL: tuple[Callable[[Tables], DataFrame], ...] = (
    document_scan, doc_cap, build_vocab, tokenize_docs, tokenize_turns, tokenize_joined, token_range_guard,
    stream_offsets, shard_cut, shard_names, shard_headers, split_totals, shard_offsets, asof_position,
    shard_roundtrip, shard_roundtrip_long, header_consistency, vocab_check, windows_fixed, windows_epoch_offset,
    windows_from_shards, windows_across_chunks, window_lookup, window_lookup_in_shards, seq_count,
    epoch_permutation, resume_tail, rank_stripes_drop, rank_stripes_pad, batches_drop_last, loader_order,
    keyed_permutation, keyed_resume, manifest_generations, windows_stream, state_resume, latest_state, pad_batches, padded_lengths, batch_assembly, attention_mask, special_mask, mlm_mask,
    electra_inputs, mask_counts, mlm_batches, span_budget, span_emit, span_sampling, span_corruption,
    target_padding, valid_labels, eval_summary, train_summary, running_loss, log_cadence, eval_cadence, masked_xent, masked_xent_blocks, mlm_sql, asof_position_merged, state_roundtrip,
    subword_tokenize,
    token_vector_lookup, token_vector_lookup_joined, masked_mean_pool, embed_joined, masked_mean_pool_states, mean_pool,
    incremental_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Tables.of(spark, sf_dir))

    return {query.__name__: bound(query) for query in ALL}
