"""Outside services as transforms of rows: programs that read JSON and write JSON, hooks around a pipeline's phases, back ends that stand in for
each other, and embedders that take texts in batches. What needs a network is given by the caller as a function."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phases of a run that hooks may be tied to.
PHASES = ("pre_search", "post_search", "post_synthesis", "pre_ingest", "post_extract", "post_resolve")


def piped(df: DataFrame, command: list[str], key: str, column: str, timeout: float = 30.0) -> DataFrame:
    """key, output, error: each row's JSON text given to a fresh process of ``command``, and what it wrote; stateless by row.

    A process that fails, writes no JSON or takes longer than ``timeout`` seconds gives an error and no output. It may stop reading
    early. The program must be on all executors.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(text: str | None) -> tuple[str | None, str | None]:
        try:
            p = subprocess.run(command, input=(text or "").encode(), capture_output=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired:
            return None, f"timed out after {timeout} s"
        except OSError as e:
            return None, f"not started: {e}"
        if p.returncode:
            return None, f"exit code {p.returncode}: {p.stderr.decode(errors='replace')[:500]}"
        try:
            return json.dumps(json.loads(p.stdout)), None
        except ValueError:
            return None, "no JSON"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=[key, "output", "error"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, output string, error string")


@dataclass
class Hook:
    """``call`` takes a payload and returns a dict. ``adapter``: only for runs of that adapter. A hook that fails open doesn't stop a run."""

    name: str
    phase: str
    call: Callable[[dict], dict]
    adapter: str | None = None
    fail_open: bool = True

    def __post_init__(self) -> None:
        if self.phase not in PHASES:
            raise ValueError(f"no phase {self.phase}")


@dataclass
class Hooks:
    hooks: list[Hook] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)

    def fire(self, phase: str, payload: dict, adapter: str | None = None) -> dict:
        """The hooks' answers, merged in their order: lists are joined, other values replaced. Hooks without an adapter fire for all runs."""
        merged: dict = {}
        for h in self.hooks:
            if h.phase != phase or h.adapter not in (None, adapter):
                continue
            try:
                answer = h.call(dict(payload))
            except Exception as e:
                if not h.fail_open:
                    raise RuntimeError(f"hook {h.name} failed: {e}") from e
                self.failed.append((h.name, str(e)))
                continue
            for k, v in (answer or {}).items():
                if isinstance(v, list):
                    merged[k] = [*merged.get(k, []), *v]
                elif v is not None:
                    merged[k] = v
        return merged


def first_that_answers(backends: list[tuple[str, Callable[[str], str]]]) -> Callable[[str], tuple[str, str]]:
    """A back end that asks the given ones (name, function) in turn and says which of them answered."""

    def ask(prompt: str) -> tuple[str, str]:
        errors = []
        for name, f in backends:
            try:
                return name, f(prompt)
            except Exception as e:
                errors.append(f"{name}: {e}")
        raise RuntimeError("no back end answered: " + "; ".join(errors))

    return ask


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], width: int, together: str | None = None, most: int = 64) -> DataFrame:
    """id, embedding: ``embed`` gets up to ``most`` texts at once, in the order of ids of a task, or all texts of one ``together`` (a document's chunks,
    which must fit into a task). Vectors are cut to ``width`` and brought to length one by the caller's function or ``vector.truncated``."""
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, embedding array<double>"

    def of(table: pa.Table | pa.RecordBatch, step: int) -> Iterator[pa.RecordBatch]:
        ids, said = table.column("id"), table.column("text").to_pylist()
        out = []
        for k in range(0, len(said), step):
            out += embed([t or "" for t in said[k : k + step]])
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        yield pa.RecordBatch.from_arrays([ids, pa.array([[float(x) for x in v[:width]] for v in out], pa.list_(pa.float64()))], names=["id", "embedding"])

    if together is None:
        return texts.select("id", "text").mapInArrow(lambda batches: (r for b in batches for r in of(b, most)), schema)
    return texts.select(together, "id", "text").groupBy(together).applyInArrow(lambda t: pa.Table.from_batches(of(t.sort_by("id"), max(len(t), 1))), schema)


def prompts(items: DataFrame, template: str, most: int = 6_000) -> DataFrame:
    """id, prompt: ``template`` with {name}, {path} and {code} of items (id, name, path, code); long code is cut at ``most`` characters, and says so."""
    code = F.when(F.length("code") > most, F.concat(F.substring("code", 1, most), F.lit("\n... (truncated)"))).otherwise(F.col("code"))
    out = F.lit(template)
    for name, value in (("{name}", F.col("name")), ("{path}", F.coalesce("path", F.lit("unknown"))), ("{code}", code)):
        out = F.replace(out, F.lit(name), F.coalesce(value, F.lit("")))
    return items.select("id", out.alias("prompt"))
