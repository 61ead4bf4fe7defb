"""Who embeds, reranks and chunks, by name; and the settings that choose them.

Providers run in Spark's Python workers, out of the driver's process. Those that
ask a server over HTTP take a function that sends a request, so that they can be
used without a network; no provider sends anything by itself.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
import threading
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Characters of a text that a server is sent, and documents' characters in a reranking request.
TEXT_CHARS, DOC_CHARS = 8000, 1000
#: Texts a request, and tokens of a chunk without a model's limit.
BATCH = {"ollama": 32, "openai": 100}
CHUNK_TOKENS = 1800
#: A score in a reranker's answer.
SCORE = r"\b(0?\.\d+|1\.0|0|1)\b"

Send = Callable[[str, dict], dict]


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class Chunker(Protocol):
    def chunks(self, files: DataFrame, tokens: int) -> DataFrame: ...


@dataclasses.dataclass(frozen=True)
class HashEmbedder:
    """Vectors from SHA-256 of the text alone, each number from -1 to 1: equal texts are equal, others have nothing in common."""

    dimensions: int = 384

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.sha256(k.to_bytes(4, "little") + t.encode()).digest() for k in range(-(-self.dimensions // 32)))
            out.append([x / 127.5 - 1 for x in raw[: self.dimensions]])
        return out


@dataclasses.dataclass(frozen=True)
class SingleEmbedder:
    """A server that takes one text a request."""

    send: Send
    model: str
    url: str
    dimensions: int = 768

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.send(f"{self.url}/api/embeddings", {"model": self.model, "prompt": t[:TEXT_CHARS]})["embedding"] for t in texts]


@dataclasses.dataclass(frozen=True)
class BatchEmbedder:
    """A server that takes many texts a request and numbers its answers."""

    send: Send
    model: str
    url: str
    dimensions: int = 1536

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo in range(0, len(texts), BATCH["openai"]):
            data = self.send(f"{self.url}/embeddings", {"model": self.model, "input": texts[lo : lo + BATCH["openai"]]})["data"]
            out += [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
        return out


@dataclasses.dataclass(frozen=True)
class PromptReranker:
    """A language model that is asked for a score a document."""

    send: Send
    model: str
    url: str
    most_docs: int = 100

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        texts = texts[: self.most_docs]
        answer = self.send(f"{self.url}/api/generate", {"model": self.model, "prompt": rerank_prompt(query, texts), "stream": False})["response"]
        return parse_scores(answer, len(texts))


def rerank_prompt(query: str, texts: list[str]) -> str:
    docs = "".join(f"[{k}] {t if len(t) <= DOC_CHARS else t[:DOC_CHARS] + '...'}\n\n" for k, t in enumerate(texts, 1))
    return f"Score how well each document answers the query, from 0.0 to 1.0.\nAnswer with one decimal number a line, in order, and nothing else.\n\nQuery: {query}\n\nDocuments:\n{docs}Scores:\n"


def parse_scores(answer: str, n: int) -> list[float]:
    """The first n scores of an answer, 0.5 for each that is missing."""
    found = [float(x) for x in re.findall(SCORE, answer)[:n]]
    return found + [0.5] * (n - len(found))


def embedded(rows: DataFrame, embedder: Embedder, id_col: str = "id", text_col: str = "content", batch: int = 32) -> DataFrame:
    """(id, embedding) of rows' texts, a batch a request; null texts have none. Errors fail the task, which Spark runs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                s = b.slice(lo, batch)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(embedder.embed(s.column(1).to_pylist()), pa.list_(pa.float32()))], ["id", "embedding"])

    texts = rows.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, embedding array<float>")


def chunk_tokens(wanted: int | None, model_tokens: int | None) -> int:
    """Tokens of a chunk: what is wanted, at most nine tenths of what the model takes."""
    return min([wanted or CHUNK_TOKENS] + ([int(0.9 * model_tokens)] if model_tokens else [CHUNK_TOKENS] if not wanted else []))


class Registry:
    """Factories by kind and name; safe to use from several threads."""

    KINDS = ("embedding", "reranker", "chunking", "store")

    def __init__(self) -> None:
        self._lock, self._known = threading.Lock(), {}

    def register(self, kind: str, name: str, factory: Callable[..., object]) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"{kind} is none of {self.KINDS}")
        with self._lock:
            if (kind, name) in self._known:
                raise ValueError(f"{kind} {name} is registered already")
            self._known[kind, name] = factory

    def create(self, kind: str, name: str, **settings) -> object:
        with self._lock:
            factory = self._known.get((kind, name))
        if factory is None:
            raise KeyError(f"no {kind} is named {name}; there are {self.names(kind)}")
        return factory(**settings)

    def names(self, kind: str) -> list[str]:
        with self._lock:
            return sorted(n for k, n in self._known if k == kind)


def registry() -> Registry:
    """A registry with what the library brings."""
    out = Registry()
    out.register("embedding", "hash", HashEmbedder)
    out.register("embedding", "ollama", SingleEmbedder)
    out.register("embedding", "openai", BatchEmbedder)
    out.register("reranker", "ollama", PromptReranker)
    return out


# ---- settings ----------------------------------------------------------------------------

#: Settings and their defaults; a name with a dot lies in a section.
DEFAULTS = {
    "embedding.provider": "ollama", "embedding.batch_size": 32, "embedding.dimensions": 768, "chunking.max_tokens": 1800, "reranker.enabled": True, "reranker.candidates": 100,
    "search.mode": "hybrid", "search.vector_weight": 0.7, "search.bm25_weight": 0.3, "search.limit": 10, "limits.max_file_size": "1MB", "limits.max_files": 50_000,
}
#: Settings that a preset changes.
PRESETS = {"recommended": {}, "high_quality": {"reranker.candidates": 200}, "large_project": {"reranker.candidates": 50}, "no_reranker": {"reranker.enabled": False}}
CHOICES = {"embedding.provider": ("ollama", "openai", "hash"), "search.mode": ("hybrid", "vector", "bm25")}


def settings(text: str = "", preset: str | None = None, **selected) -> tuple[dict, list[str]]:
    """(settings, warnings): defaults, then a preset, then a file's text (lines `name: value` in sections), then what is selected."""
    if preset is not None and preset not in PRESETS:
        raise KeyError(f"no preset is named {preset}; there are {sorted(PRESETS)}")
    out, warnings, section = DEFAULTS | PRESETS.get(preset or "", {}), [], ""
    for k, line in enumerate(text.splitlines(), 1):
        body = line.split("#")[0].rstrip()
        if not body.strip():
            continue
        name, colon, value = body.partition(":")
        if not colon:
            warnings.append(f"line {k} isn't name: value")
        elif not line[0].isspace() and not value.strip():
            section = name.strip()
        else:
            key = f"{section}.{name.strip()}" if line[0].isspace() else name.strip()
            if key in DEFAULTS:
                out[key] = _value(value.strip())
            else:
                warnings.append(f"{key} isn't known")
    return out | {k.replace("__", "."): v for k, v in selected.items()}, warnings


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text.strip("'\"")


def problems(values: dict) -> list[str]:
    """What is wrong with settings."""
    out = [f"{k} must be one of {v}" for k, v in CHOICES.items() if values.get(k) not in v]
    out += [f"{k} must be above 0" for k in ("embedding.batch_size", "embedding.dimensions", "chunking.max_tokens", "search.limit", "limits.max_files") if not (isinstance(values.get(k), int) and values[k] > 0)]
    weights = [values.get(f"search.{w}_weight") for w in ("vector", "bm25")]
    return out + (["weights must be from 0 to 1"] if not all(isinstance(w, (int, float)) and 0 <= w <= 1 for w in weights) else [])


def settings_text(values: dict) -> str:
    """Settings as a file's text, which `settings` reads back."""
    out, section = [], None
    for key in sorted(values):
        head, _, name = key.partition(".")
        if head != section:
            section = head
            out.append(f"{head}:")
        out.append(f"  {name}: {json.dumps(values[key])}")
    return "\n".join(out) + "\n"


def settings_hash(values: dict) -> str:
    """Hash of what settings mean for an index; a change asks for indexing anew (Q21)."""
    return hashlib.sha256(json.dumps({k: v for k, v in values.items() if k.split(".")[0] in ("embedding", "chunking", "limits")}, sort_keys=True).encode()).hexdigest()


def project_class(files: int) -> str:
    """small, medium, large or huge by the number of files."""
    return "small" if files < 100 else "medium" if files < 1000 else "large" if files < 10_000 else "huge"
