"""Model-based labels: an injected caller in bounded batches, and the merge back by id."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.batches import slices
from docmill.functions.jsvalue import parse, write
from docmill.operators.dynamic import blank_runs, count_empty

LEVELS = ("N0", "N1", "N2", "UNKNOWN")
SCHEMA = "id string, level string, tags array<string>, summary string, error string"
_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.I)


def normal_tags(tags: Column, most: int = 2) -> Column:
    """Trimmed, lower-cased, distinct in order, the first ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")), 1, most)


def parse_answer(text: str) -> dict:
    """The JSON object of an answer: fenced, bare, or between the outermost braces."""
    fenced = _FENCE.search(text)
    for part in (fenced[1] if fenced else text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError("no JSON object in the answer")


def hide_secrets(error: object) -> str:
    """An error's text with keys and bearer tokens masked, 240 characters at most."""
    text = re.sub(r"sk-[A-Za-z0-9_-]+", "[SECRET_REDACTED]", str(error))
    return re.sub(r"(?i)Bearer\s+[A-Za-z0-9._-]+", "Bearer [SECRET_REDACTED]", text)[:240]


def clamp(value, default: int, least: int, most: int) -> int:
    """A whole number within bounds; what is no finite number is the default."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
        return default
    return min(most, max(least, int(value)))


def item_fields(df: DataFrame, content: str = "body_markdown", title: str = "title", category: str = "categorie", record: str = "record") -> DataFrame:
    """pos, id, title, categorie and content of JSON objects (variant): a named field, else the usual ones; nulls fall through, absent ones are empty."""
    of = lambda *keys: F.coalesce(*[_text(F.try_variant_get(record, f"$['{k}']", "variant")) for k in keys], F.lit(""))
    return df.select("pos", of("id").alias("id"), of(title, "title").alias("title"), of(category, "categorie").alias("categorie"), of(content, "body_markdown", "content").alias("content"))


def _text(v: Column) -> Column:
    """A JSON value as text: scalars as they are, others as JSON; null stays null."""
    kind = F.schema_of_variant(v)
    return F.when(v.isNull() | (kind == "VOID"), F.lit(None).cast("string")).when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def request(item: dict, prompt_id: str | None, version: str | None = None) -> dict:
    """What is sent for an item: a stored prompt, which must be named, and the item as JSON text."""
    if not prompt_id:
        raise ValueError("a prompt id is needed")
    prompt = {"id": prompt_id} | ({"version": version} if version else {})
    return {"prompt": prompt, "input": [{"role": "user", "content": [{"type": "input_text", "text": json.dumps(item, ensure_ascii=False, separators=(",", ":"))}]}]}


def response_text(response: object) -> str:
    """The text of an answer: output_text if it says anything, else the texts of all parts of the output, a line each."""
    if not isinstance(response, dict):
        return ""
    said = response.get("output_text")
    if isinstance(said, str) and said.strip():
        return said
    dicts = lambda x: [y for y in x if isinstance(y, dict)] if isinstance(x, list) else []
    parts = (p for item in dicts(response.get("output")) for p in dicts(item.get("content")))
    return "\n".join(p["text"] for p in parts if isinstance(p.get("text"), str)).strip()


def client_caller(send: Callable[[dict], object], prompt_id: str, version: str | None = None) -> Callable[[dict], str]:
    """A caller of :func:`qualify` over an injected client that takes a request and gives a response."""
    return lambda item: response_text(send(request(item, prompt_id, version)))


FIELDS = ("id", "title", "categorie", "content")


def answer(item: dict, caller: Callable[[dict], str], retries: int, backoff_ms: int) -> tuple[tuple, int]:
    """(id, level, tags, summary, error) of an item by its caller's answer, and the number of calls that took; UNKNOWN with the error if all fail."""
    for attempt in range(retries + 1):
        try:
            a = parse_answer(caller(item))
            tags: list[str] = []
            for t in a.get("tags") or []:
                if isinstance(t, str) and (t := t.strip().lower()) and t not in tags:
                    tags.append(t)
            level = a.get("level") if a.get("level") in LEVELS else "UNKNOWN"
            return (str(a.get("id") or item["id"] or ""), level, tags[:2], str(a.get("summary") or ""), None), attempt + 1
        except Exception as e:
            error = hide_secrets(e)
            if attempt < retries:
                time.sleep(backoff_ms * 2**attempt / 1000)
    return (str(item["id"] or ""), "UNKNOWN", [], "", error), retries + 1


def qualify(items: DataFrame, caller: Callable[[dict], str], retries: int = 2, backoff_ms: int = 400, threads: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """A label for each item (id, title, categorie, content), asked for whenever the result is worked out (see :func:`docmill.operators.answers.ask` for answers that last).

    An item whose calls all fail is UNKNOWN with its error. Columns in ``keep`` stay.
    Calls in flight are at most partitions times ``threads``. Retries are clamped to 0 to 5, the back-off to 0 to 30,000 ms, threads to 1 to 20.
    """
    retries, backoff_ms, threads = clamp(retries, 2, 0, 5), clamp(backoff_ms, 400, 0, 30_000), clamp(threads, 5, 1, 20)

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                rows = [r for r, _ in pool.map(lambda item: answer(item, caller, retries, backoff_ms), b.select(list(FIELDS)).to_pylist())]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
                made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, "id", "level", "tags", "summary", "error"])

    kept = items.select(*keep).schema.fields
    return items.select(*keep, *FIELDS).mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(SCHEMA).fields]))


def merge(items: DataFrame, labels: DataFrame, position: str = "pos") -> DataFrame:
    """Items (id, ...) with level, tags and summary of their label; of labels with one id the last by ``position`` wins."""
    last = labels.groupBy(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")).agg(F.max_by(F.struct("level", "tags", "summary"), position).alias("q"))
    keyed = items.withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("")))
    return keyed.join(last, "key", "left").select(*items.columns, "q.level", "q.tags", "q.summary")


def with_labels(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with level, tags and summary written into the JSON object in ``text``, and n_empty and n_blank_runs of what it is then (see dynamic.transform).

    Fields of these names take the new values where they stand, other fields stay; without a label (null level) nothing changes.
    """
    at = {n: i for i, n in enumerate(df.columns)}

    def run(batches):
        for b in slices(batches):
            out: list[list] = [[], [], []]
            for item, level, tags, summary in zip(*(b.column(at[c]).to_pylist() for c in (text, "level", "tags", "summary")), strict=True):
                value = parse(item) | ({} if level is None else {"level": level, "tags": tags or [], "summary": summary or ""})
                new = write(value)
                for col, x in zip(out, (new, count_empty(value), blank_runs(new)), strict=True):
                    col.append(x)
            b = b.set_column(at[text], text, pa.array(out[0], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=[*b.schema.names, "n_empty", "n_blank_runs"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("n_empty", T.LongType()), T.StructField("n_blank_runs", T.LongType())]))
