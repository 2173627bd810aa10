"""Requests to a model in batches: prompts, token estimates, chunks, costs, and what the answers' files say."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import numbered

#: Dollars for a million input, cached input and output tokens.
PRICES: Mapping[str, tuple[float, float, float]] = {"large": (2.0, 0.5, 8.0), "medium": (0.4, 0.1, 1.6), "nano": (0.1, 0.025, 0.4), "small": (0.15, 0.075, 0.6)}


def tokens(chars: Column, most: Column | None = None) -> Column:
    """What a request may take: a token for three characters, a fixed part, and the longest answer."""
    return (chars / 3.0 + 0.9999).cast("long") + 40 + F.coalesce(most if most is not None else F.lit(None), F.lit(4096)).cast("long")


def request_rows(batched: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """batched: rows with `batch`. (by, batch, n_texts, prompt), a row a batch."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text])
    return batched.groupBy(by, "batch").agg(F.count("*").alias("n_texts"), texts.alias("texts")).select(by, "batch", "n_texts", numbered("texts").alias("prompt"))


def request_lines(requests: DataFrame, by: str, model: str, most: int) -> DataFrame:
    """(custom_id, line): requests as lines of JSON."""
    key = F.concat_ws("-", F.regexp_replace(by, r"[^\w\-]", "_"), F.col("batch").cast("string"))
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"), F.lit(most).alias("max_tokens"))
    line = F.to_json(F.struct(key.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    return requests.select(key.alias("custom_id"), line.alias("line"))


def chunks(jobs: DataFrame, stream: str, order: str, *, most_jobs: int, most_bytes: int, most_tokens: int | None) -> DataFrame:
    """jobs: (stream, order, bytes, tokens). Each job with `chunk`, from 0 within its stream: jobs go in order to the open chunk; one that would make it too many, too
    long or too dear opens the next. A job too dear by itself has a chunk of its own; one of more bytes than a chunk may have is an error.

    Where a chunk begins hangs on where the last one ended, so a stream's sizes pass through one task in order, batch by batch; what it holds is the open chunk's sums."""
    jobs_cap = max(1, min(most_jobs, 50_000))
    rows = jobs.select(stream, order, F.col("bytes").cast("long").alias("bytes"), F.col("tokens").cast("long").alias("tokens"))
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk, n, size, spent = None, 0, 0, 0, 0
        for batch in batches:
            out = []
            for name, b, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if b > most_bytes:
                    raise ValueError(f"a job of {b} bytes has more bytes than a chunk may have")
                if (name,) != last:
                    last, chunk, n, size, spent = (name,), 0, 0, 0, 0
                if n and (n >= jobs_cap or size + b > most_bytes or (most_tokens is not None and spent + t > most_tokens)):
                    chunk, n, size, spent = chunk + 1, 0, 0, 0
                n, size, spent = n + 1, size + b, spent + t
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "chunk"])

    return rows.repartition(stream).sortWithinPartitions(stream, order).mapInArrow(fold, schema)


def counted(texts: Column | str) -> Column:
    """A prompt that says how many texts there are, before and behind them, and which one is the last."""
    own = F.col(texts) if isinstance(texts, str) else texts
    n = F.size(own).cast("string")
    items = F.transform(own, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.when(i + 1 == F.size(own), F.lit(", LAST] ")).otherwise(F.lit("] ")), t))
    return F.concat(F.lit("Texts: "), n, F.lit("\n\n"), F.concat_ws("\n\n", items), F.lit("\n\nAnswer with exactly "), n, F.lit(" items, one for each text."))


def tagged(texts: Column | str, tags: Column | str) -> Column:
    """A prompt of texts with their tags; tags: a list of lists."""
    own, said = (F.col(c) if isinstance(c, str) else c for c in (texts, tags))
    line = lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t, F.lit("\ntags: "), F.coalesce(F.nullif(F.concat_ws(", ", F.get(said, i)), F.lit("")), F.lit("(empty)")))
    return F.concat_ws("\n\n", F.transform(own, line))


def flattened(messages: DataFrame, by: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(by, prompt): a conversation's messages in order as one text, for models that take no messages. A null text is empty."""
    line = F.concat(F.coalesce(F.col(role), F.lit("user")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"])
    return messages.groupBy(by).agg(F.concat_ws("\n", lines).alias("prompt"))


def answer_schema(categories: Mapping[str, Sequence[str]], n: int) -> tuple[str, dict]:
    """The JSON schema of an answer of n items, each with a list of a category's own values for every category, and its name, which follows the content."""
    item = {"type": "object", "additionalProperties": False, "required": sorted(categories), "properties": {c: {"type": "array", "items": {"type": "string", "enum": sorted(set(vs))}} for c, vs in sorted(categories.items())}}
    schema = {"type": "object", "additionalProperties": False, "required": ["captions"], "properties": {"captions": {"type": "array", "minItems": n, "maxItems": n, "items": item}}}
    digest = hashlib.sha1(json.dumps(schema, sort_keys=True).encode()).hexdigest()[:10]
    return f"answer_{digest}", schema


def context_room(prompt_tokens: Column, window: int, most: int, margin: int = 32, least: int = 64) -> Column:
    """How long an answer may be beside a prompt; an error where hardly any room is left."""
    room = F.lit(window) - prompt_tokens - margin
    return F.when(room < least, F.raise_error(F.lit("the prompt leaves no room for an answer"))).otherwise(F.least(room, F.lit(most))).cast("long")


def cost(usage: DataFrame, prices: Mapping[str, tuple[float, float, float]] = PRICES, cached: float = 0.8) -> DataFrame:
    """usage: (model, input_tokens, output_tokens). Their cost in dollars, and in a batch, which is half."""
    known = usage.sparkSession.createDataFrame([(m, *p) for m, p in prices.items()], "model string, i double, c double, o double")
    hit = (F.col("input_tokens") * cached).cast("long")
    out = usage.join(F.broadcast(known), "model").withColumns({"cached_input_tokens": hit, "uncached_input_tokens": F.col("input_tokens") - hit})
    a, b, c = F.col("uncached_input_tokens") * F.col("i") / 1e6, F.col("cached_input_tokens") * F.col("c") / 1e6, F.col("output_tokens") * F.col("o") / 1e6
    return out.select(
        *usage.columns, "cached_input_tokens", "uncached_input_tokens", F.bround(a, 4).alias("input_cost_usd"), F.bround(b, 4).alias("cached_cost_usd"), F.bround(c, 4).alias("output_cost_usd"),
        F.bround(a + b + c, 4).alias("total_cost_usd"), F.bround((a + b + c) * 0.5, 4).alias("batch_cost_usd"),
    )


def output_budget(n: Column, strict: bool) -> Column:
    """The longest answer for n texts."""
    return F.greatest(F.lit(512), F.least(F.lit(8192), (220 if strict else 90) * n + 200)).cast("long")


def chunk_tokens(limit: Column, concurrency: Column) -> Column:
    """What one of several chunks at once may take of an account's limit, with a margin of a quarter."""
    return F.greatest(F.lit(100_000), F.floor((limit - F.greatest(F.lit(250_000), F.floor(limit / 4))) / concurrency)).cast("long")


def safe_batch(most: Column, features: Column) -> Column:
    """How many texts' full answers fit in `most` tokens."""
    return F.greatest(F.lit(1), F.floor(most * 0.8 / (7 * features + 40))).cast("long")


USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,prompt_tokens_details:struct<cached_tokens:bigint>>"
BODY = f"struct<usage:{USAGE},choices:array<struct<finish_reason:string,message:struct<content:string>>>>"


def answers(lines: DataFrame) -> DataFrame:
    """lines: (line). (custom_id, content, finish_reason, prompt_tokens, completion_tokens, cached_tokens) of the answered requests. A body may be an object or a string of JSON; errors, other
    statuses than 200 and what isn't JSON are left out."""
    outer = F.from_json("line", "struct<custom_id:string,error:string,response:struct<status_code:int,body:string>>")
    rows = lines.select(outer.alias("r")).where("r.custom_id is not null and r.error is null and r.response.status_code = 200")
    said = rows.select("r.custom_id", F.from_json("r.response.body", BODY).alias("b"))
    first = F.get("b.choices", F.lit(0))
    return said.where(F.size("b.choices") > 0).select(
        "custom_id", first["message"]["content"].alias("content"), first["finish_reason"].alias("finish_reason"), F.coalesce("b.usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.coalesce("b.usage.completion_tokens", F.lit(0)).alias("completion_tokens"), F.coalesce("b.usage.prompt_tokens_details.cached_tokens", F.lit(0)).alias("cached_tokens"),
    )


def usage_totals(answered: DataFrame) -> DataFrame:
    return answered.agg(F.count("*").alias("n_answers"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens")))


def errors(lines: DataFrame) -> DataFrame:
    """(code, n_errors) of lines that name an error; failed_ids has their ids."""
    return failed_ids(lines).groupBy("code").agg(F.count("*").alias("n_errors"))


def failed_ids(lines: DataFrame) -> DataFrame:
    """(custom_id, code), a row a line that names an error."""
    row = F.from_json("line", "struct<custom_id:string,error:struct<code:string>>").alias("r")
    return lines.select(row).where("r.error is not null").select("r.custom_id", F.coalesce("r.error.code", F.lit("unknown")).alias("code"))


def unanswered(sent: DataFrame, answered: DataFrame) -> DataFrame:
    return sent.join(answered.select("custom_id"), "custom_id", "left_anti")


def ranked(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
