"""Running translation jobs with a pluggable model.

The model is the only part that leaves the JVM: jobs go through one `mapInPandas`, a job a row, with
failures kept to their rows. Persist the result before using it twice, as a model may not repeat itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields as FF
from ..functions import frontmatter as FM
from ..functions.markdown import body
from ..functions.texts import language_name
from ..sources.templates import fill, template
from .diffs import DiffError, apply_diff, parse_diff, unified_diff
from .history import SKIP, UPDATE
from .split import TARGET, chunks


class Answer(NamedTuple):
    text: str
    input_tokens: int = 0
    output_tokens: int = 0


class Permanent(RuntimeError):
    """A failure that makes all further calls pointless, such as a refused key."""


class Translator(Protocol):
    def __call__(self, system: str, user: str, locale: str) -> Answer: ...


class UpperCase:
    """A model for tests that needs no network: upper case, a token for each word."""

    def __call__(self, system: str, user: str, locale: str) -> Answer:
        if user.startswith("Original:\n"):
            text = ""
        elif user.startswith(FF.HEADER):
            import re

            text = re.sub(r"(?s)(\[\[([^\]\n]+)\]\]\n)(.*?)(\n\[\[/\2\]\])", lambda m: m[1] + m[3].upper() + m[4], user.removeprefix(FF.HEADER).strip())
        else:
            text = user.upper()
        return Answer(text, len(user.split()), len(text.split()))


def model_for(provider: str, url: str, token: str | None, model: str, call: Callable[[dict[str, Any]], Answer]) -> Translator:
    """A translator of a provider (`openai` or `anthropic`, in any case) over a transport.

    `call` gets the request as a dictionary: provider, url, token, model, temperature, timeout, system,
    user. The url has no final slash; an empty token is `none` for the former and an error for the latter.
    """
    kind = provider.strip().lower()
    if kind not in ("openai", "anthropic"):
        raise ValueError(f"unknown provider {provider!r}")
    if not url or not url.strip():
        raise ValueError("a url is needed")
    if not (token or "").strip():
        if kind == "anthropic":
            raise ValueError("a token is needed")
        token = "none"
    base = {"provider": kind, "url": url.strip().rstrip("/"), "token": token, "model": model, "temperature": 0.3, "timeout": 300}
    return lambda system, user, locale: call(base | {"system": system, "user": user})


class Breaker:
    """Passes calls on until one fails for good; then every call fails at once."""

    def __init__(self, model: Translator):
        self.model, self.broken = model, None

    def __call__(self, system: str, user: str, locale: str) -> Answer:
        if self.broken is not None:
            raise Permanent(f"not called: {self.broken}")
        try:
            return self.model(system, user, locale)
        except Permanent as e:
            self.broken = str(e)
            raise


def _parse_blocks(text: str, keys: list[str]) -> tuple[dict[str, str], list[str]]:
    import re

    found = {m[1].strip(): m[2].strip() for m in re.finditer(r"(?s)\[\[([^\]\n]+)\]\]\s*\n?(.*?)\n?\s*\[\[/\1\]\]", text)}
    good = {k: found[k] for k in keys if found.get(k)}
    return good, [k for k in keys if k not in good]


class _Run:
    """One job: two phases, with the tokens of all attempts."""

    def __init__(self, model: Translator, job: dict[str, Any]):
        self.model, self.job = model, job
        self.tokens_in = self.tokens_out = 0

    def ask(self, system: str, user: str) -> str:
        a = self.model(system, user, self.job["locale"])
        self.tokens_in += int(a.input_tokens)
        self.tokens_out += int(a.output_tokens)
        return a.text or ""

    def prompt(self, name: str, **values: str | None) -> str:
        said = {"language": self.job["language"], "instructions": self.job["instructions"] or ""}
        return fill(template(name), said | {k: v or "" for k, v in values.items()})

    def fields(self) -> list[dict[str, str]]:
        wanted = self.job["fields"]
        if not len(wanted):
            return []
        answer = self.ask(self.prompt("fields-system"), self.prompt("fields-user", fields=self.job["field_blocks"]))
        good, missing = _parse_blocks(answer, [f["key"] for f in wanted])
        if missing:
            raise _Failed("FRONT_MATTER", f"no translation of {', '.join(missing)}")
        return [{"key": k, "value": v} for k, v in good.items()]

    def new_body(self) -> str:
        parts = self.job["chunks"]
        out = ""
        for k, c in enumerate(parts):
            try:
                text = self.ask(self.prompt("body-system"), self.prompt("body-user", content=c)) if c.strip() else c
            except Permanent:
                raise
            except Exception as e:
                raise _Failed("BODY" if len(parts) == 1 else f"BODY_CHUNK_{k + 1}", str(e)) from e
            out = out + text if not out or out.endswith("\n") else out + "\n\n" + text
        return out

    def updated_body(self) -> str:
        job, had = self.job, self.job["existing_body"] or ""
        system = self.prompt("diff-system")
        try:
            answer = self.ask(system, self.prompt("diff-user", original=job["original_body"], diff=job["diff"], translation=had))
        except Permanent:
            raise
        except Exception as e:
            raise _Failed("BODY_DIFF", str(e)) from e
        first: DiffError | None = None
        for attempt in (1, 2):
            if not answer.strip():
                return had
            try:
                hunks = parse_diff(answer)
                return apply_diff(had, hunks) if hunks else had
            except DiffError as e:
                if attempt == 2:
                    raise _Failed("BODY_DIFF", f"no diff that fits after a second attempt: {first}; then {e}") from e
                first = e
            try:
                answer = self.ask(system, self.prompt("diff-retry", response=answer, translation=had))
            except Permanent:
                raise
            except Exception as e:
                raise _Failed("BODY_DIFF", str(e)) from e
        return had


class _Failed(Exception):
    def __init__(self, phase: str, message: str):
        super().__init__(f"[{phase}] {message}")


RESULT = (
    "locale string, path string, target_path string, type string, current_commit string, success boolean, error string, "
    "fields array<struct<key: string, value: string>>, body string, input_tokens long, output_tokens long, attempted_input_tokens long, attempted_output_tokens long, elapsed_millis long"
)


def prepared(jobs: DataFrame, keys: list[str], target_bytes: int = TARGET) -> DataFrame:
    """Jobs that aren't skipped with all that a model run needs: fields, chunks of the body, diff of the source."""
    todo = jobs.where(F.col("type") != SKIP)
    source = F.coalesce("source", F.lit(""))
    todo = todo.withColumn("fields", FF.extract_fields(FM.parse_properties(source), keys)).withColumn("field_blocks", FF.format_fields(F.col("fields")))
    update = F.col("type") == UPDATE
    todo = todo.withColumn("chunks", F.when(update, F.array().cast("array<string>")).otherwise(F.transform(chunks(body(source), target_bytes), lambda c: c["content"])))
    todo = todo.withColumn("original_body", F.when(update, body(F.col("original_source")))).withColumn("existing_body", F.when(update, body(F.col("existing"))))
    todo = todo.withColumn("diff", F.when(update, unified_diff(F.col("original_body"), body(source))))
    return todo.withColumn("language", language_name(F.col("locale")))


def translate(jobs: DataFrame, model: Translator, keys: list[str], parallelism: int | None = None, target_bytes: int = TARGET) -> DataFrame:
    """A result row for every job that isn't skipped (see RESULT).

    Fields come first, when there are any; a failure there leaves the body alone. New documents are
    translated chunk by chunk, in order; changed ones by a diff of the translation, with a second attempt
    if the first doesn't parse or fit. A failed job has an error that begins with its phase, and no
    tokens of its own; the attempted ones count all calls. After a permanent failure the rest of the
    partition isn't tried. parallelism: how many calls may be under way at a time.
    """
    todo = prepared(jobs, keys, target_bytes)
    if parallelism is not None:
        todo = todo.repartition(parallelism, "path", "locale")
    columns = ["locale", "path", "target_path", "type", "current_commit", "instructions", "fields", "field_blocks", "chunks", "original_body", "existing_body", "diff", "language"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guarded = Breaker(model)
        for frame in frames:
            out = []
            for job in frame.to_dict("records"):
                began, work = time.monotonic(), _Run(guarded, job)
                fields, text, error = [], None, None
                try:
                    fields = work.fields()
                    text = work.updated_body() if job["type"] == UPDATE else work.new_body()
                except _Failed as e:
                    error = str(e)
                except Permanent as e:
                    error = f"[PERMANENT] {e}"
                except Exception as e:
                    error = f"[FRONT_MATTER] {e}"
                ok = error is None
                out.append(
                    {k: job[k] for k in ("locale", "path", "target_path", "type", "current_commit")}
                    | {
                        "success": ok, "error": error, "fields": fields if ok else [], "body": text if ok else None,
                        "input_tokens": work.tokens_in if ok else 0, "output_tokens": work.tokens_out if ok else 0,
                        "attempted_input_tokens": work.tokens_in, "attempted_output_tokens": work.tokens_out, "elapsed_millis": int((time.monotonic() - began) * 1000),
                    }
                )
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.replace("key: string", "k").replace("value: string", "v").replace(", v>>", ">>").split(", ")])

    return todo.select(*columns).mapInPandas(run, RESULT)


def translate_texts(rows: DataFrame, model: Translator, text: str = "text", locale: str = "locale", instructions: str | None = None) -> DataFrame:
    """The rows with `translated` and `error`: free texts, each by one prompt, outside the jobs of documents.

    A NULL or blank text is its own translation and isn't sent.
    """
    lead = F.lit(f"{instructions.strip()}\n\n" if instructions and instructions.strip() else "")
    prompt = F.concat(lead, F.lit("Translate into "), language_name(F.col(locale)), F.lit(":\n\n"), F.col(text))
    asked = rows.withColumn("__prompt", F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", prompt))
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guarded = Breaker(model)
        for frame in frames:
            out = []
            for question, own, tag in zip(frame["__prompt"], frame[text], frame[locale], strict=True):
                try:
                    out.append((own if question is None else guarded("", question, tag).text, None))
                except Permanent as e:
                    out.append((None, f"[PERMANENT] {e}"))
                except Exception as e:
                    out.append((None, str(e)))
            yield frame[names].assign(translated=pd.Series([a for a, _ in out], dtype=object, index=frame.index), error=pd.Series([b for _, b in out], dtype=object, index=frame.index))

    schema = T.StructType([*rows.schema.fields, T.StructField("translated", T.StringType()), T.StructField("error", T.StringType())])
    return asked.mapInPandas(run, schema)


def assemble(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """locale, path, content of the documents to write, for the results that succeeded.

    All properties of the source in its order, with the translated fields, then `commit`, in its place
    or last. An update's fields that didn't change keep the existing translation's values.
    """
    ok = results.where("success").select("locale", "path", "target_path", "fields", "body", "current_commit", "type")
    src = jobs.select("locale", "path", "source", "existing", "original_source")
    both = ok.join(src, ["locale", "path"])
    props = FM.parse_properties(F.col("source"))
    old, had = FM.parse_properties(F.coalesce("original_source", F.lit(""))), FM.parse_properties(F.coalesce("existing", F.lit("")))
    both = both.withColumn("props", props).withColumn("old", old).withColumn("had", had)

    def value(f):
        same = FM.get_property(F.col("props"), f["key"]).eqNullSafe(FM.get_property(F.col("old"), f["key"])) & (F.col("type") == UPDATE)
        return F.when(same, F.coalesce(FM.get_property(F.col("had"), f["key"]), f["value"])).otherwise(f["value"])

    new = F.transform("fields", lambda f: F.struct(f["key"].alias("key"), F.array(value(f)).alias("values")))
    merged = FM.set_property(FM.merge_properties(F.col("props"), new), "commit", F.array("current_commit"))
    return both.select("locale", F.col("target_path").alias("path"), F.concat(FM.serialize_properties(merged), "body").alias("content"))


def summary(results: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: success, failed, skipped, input_tokens, output_tokens, attempted tokens, all_successful, has_failures.

    The first token counts are those of jobs that succeeded, the attempted ones those of all calls.
    """
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    row = results.agg(
        F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"),
        *[zero(c) for c in ("input_tokens", "output_tokens", "attempted_input_tokens", "attempted_output_tokens")],
    )
    left_out = skipped.agg(F.count("*").alias("skipped")) if skipped is not None else results.sparkSession.range(1).selectExpr("0L skipped")
    row = row.crossJoin(left_out)
    return row.withColumn("all_successful", F.col("failed") == 0).withColumn("has_failures", F.col("failed") > 0)


def merge_summaries(rows: DataFrame) -> DataFrame:
    """The sum of summaries; no rows give zeros."""
    names = ["success", "failed", "skipped", "input_tokens", "output_tokens", "attempted_input_tokens", "attempted_output_tokens"]
    row = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return row.withColumn("all_successful", F.col("failed") == 0).withColumn("has_failures", F.col("failed") > 0)


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """path, input_tokens, output_tokens, elapsed_millis, failed_chunk: sums up to and with the first chunk that failed.

    chunks: (path, index, success, input_tokens, output_tokens, elapsed_millis).
    """
    first = chunks.groupBy("path").agg(F.min(F.when(~F.col("success"), F.col("index"))).alias("failed_chunk"))
    met = chunks.join(first, "path").where("failed_chunk is null or index <= failed_chunk")
    return met.groupBy("path", "failed_chunk").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("elapsed_millis").alias("elapsed_millis"))


def first_permanent_failure(results: DataFrame) -> DataFrame:
    """path, error of the first job, in the order of paths, that failed for good; no row without one."""
    bad = results.where(F.col("error").startswith("[PERMANENT]"))
    return bad.agg(F.min(F.struct("path", "error")).alias("x")).where("x is not null").select("x.path", "x.error")


def successful_targets(results: DataFrame) -> DataFrame:
    return results.where("success").select("target_path").distinct()
