"""From a question to an answer without a model: signals, structured matches, template texts.

Models are injected callables (`Models`), neutral by default: no rewriting by a model, hashed
embeddings, a constant cross-encoder, no generated text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that end a product's name, and cues of ingredients and comparisons.
PRODUCTS = r"(?:shampoo|conditioner|cream|lotion|gel|soap|cleanser|toner|deodorant|sunscreen|lipstick|balm|wash|mask|serum|stick)"
_TITLE = re.compile(rf"\b((?:[A-Z][\w'/-]*[\s]+){{0,5}}?(?:[A-Z][\w'/-]*)\s+{PRODUCTS}|[A-Z][\w'/-]*[\s-]+{PRODUCTS})\b", re.I)
_PAIR = re.compile(rf"\b(?:compare|difference(?:s)? between)\s+(?:the\s+)?(.{{3,60}}?{PRODUCTS})\s+(?:and|with|to|vs\.?|versus)\s+(?:the\s+)?(.{{3,60}}?{PRODUCTS})\b", re.I)
_WITH = re.compile(r"\b(?:contain(?:s|ing)?|with|uses?|using|includes?|including)\s+(?:both\s+)?([a-z0-9][\w\s/-]{2,40}?)(?:\s+and\s+([a-z0-9][\w\s/-]{2,40}?))?(?=[.?,;]|$)", re.I)
_LEADING = re.compile(r"^(?:(?:give|show|get|list|provide|me|the|a|an|for|of|is|what|which|please|formula|recipe|how|make|to)\s+)+", re.I)


@dataclass(frozen=True)
class Signals:
    named: tuple[str, ...] = ()
    compare: tuple[str, ...] = ()
    required: tuple[str, ...] = ()


def _distinct(names: list[str]) -> tuple[str, ...]:
    seen: dict[str, str] = {}
    for n in names:
        own = _LEADING.sub("", n.strip(" .,;:?"))
        if len(own) >= 4:
            seen.setdefault(own.lower(), own[:80])
    return tuple(seen.values())


def signals(question: str | None) -> Signals:
    """Products that a question names or compares, and ingredients that it asks for."""
    q = (question or "").strip()
    pair = _PAIR.search(q)
    compare = _distinct([pair[1], pair[2]]) if pair else ()
    titles = [m[1] for m in _TITLE.finditer(q) if re.match(r"[A-Z]", _LEADING.sub("", m[1]))]
    named = tuple(n for n in _distinct(titles) if n.lower() not in {c.lower() for c in compare})
    required = [x for m in _WITH.finditer(q) for x in (m[1], m[2]) if x and not re.search(PRODUCTS, x, re.I)]
    return Signals(named, compare, _distinct(required))


def with_signals(questions: DataFrame, text: str = "text") -> DataFrame:
    """``questions`` with named, compare and required: arrays of names."""
    kinds = questions.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields) + ", named array<string>, compare array<string>, required array<string>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [signals(t) for t in part[text]]
            yield part.assign(named=[list(s.named) for s in found], compare=[list(s.compare) for s in found], required=[list(s.required) for s in found])

    return questions.mapInPandas(run, schema)


def hashed_embedding(text: str, dims: int = 64) -> list[float]:
    """A deterministic stand-in for a model: signed word hashes, of length 1."""
    out = [0.0] * dims
    for word in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        out[h % dims] += 1.0 if h >> 63 else -1.0
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


@dataclass(frozen=True)
class Models:
    embed: Callable[[str], list[float]] = hashed_embedding
    cross: Callable[[str, str], float] = lambda question, passage: 0.5
    generate: Callable[[str], str | None] = field(default=lambda prompt: None)


def embedded(rows: DataFrame, text: str = "text", models: Models | None = None) -> DataFrame:
    """``rows`` with an ``embedding`` of each text, in Arrow batches."""
    embed = (models or Models()).embed

    @F.pandas_udf("array<float>")
    def vector(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: embed(t or ""))

    return rows.withColumn("embedding", vector(F.col(text)))


def ingredient_table(items: list[dict]) -> str:
    """A recipe's lines in Markdown; amounts without a value are shown as fill."""
    show = lambda x: "q.s." if x["amount"] is None else f"{x['amount']:g} {x['unit'] or ''}".strip()
    return "\n".join(["| Ingredient | Amount |", "| --- | --- |", *(f"| {x['raw_name']} | {show(x)} |" for x in items)])


def lookup_answer(name: str, items: list[dict], steps: list[str], page: int | None = None) -> str:
    """The answer to a question for one recipe."""
    parts = [f"**{name}**" + (f" (p. {page})" if page is not None else ""), ingredient_table(items)]
    if steps:
        parts.append("\n".join(f"{k}. {s}" for k, s in enumerate(steps, 1)))
    return "\n\n".join(parts)


def compare_answer(left: str, right: str, diff: list[dict]) -> str:
    """The answer to a comparison: what one side has alone, and amounts that differ."""
    only = lambda side: ", ".join(sorted(d["key"] for d in diff if d["side"] == side)) or "none"
    amounts = [f"- {d['key']}: {d['left_amount']} / {d['right_amount']}" for d in sorted(diff, key=lambda d: d["key"]) if d["side"] == "both"]
    return "\n".join([f"**{left}** and **{right}**", f"Only in {left}: {only('left')}", f"Only in {right}: {only('right')}", *amounts])


def prompt(question: str, sources: list[dict], history: list[dict] = (), limit: int = 280) -> str:
    """What a model is asked: numbered sources, the talk so far, and the question."""
    lines = [f"[{k}] {s['doc_id']} p.{s['pdf_page']}: {s['text'][:limit]}" for k, s in enumerate(sources, 1)]
    talk = [f"{h['role']}: {h['text']}" for h in history]
    return "\n".join(["SOURCES", *lines, *(["HISTORY", *talk] if talk else []), "QUESTION", question])


def evidence(hits: DataFrame, top: int = 5, quote: int = 280) -> DataFrame:
    """Citations of an answer: the first hits, their quotes, and how sure they are."""
    score = F.col("score")
    label = F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")
    return hits.filter(F.col("pos") < top).withColumns({"quote": F.substring("text", 1, quote), "confidence": label})


# Levels of confidence, the first where none is given.
CONFIDENCE = ["low", "medium", "high"]
_OUTPUT = "answer string, citations array<struct<source_index:string,quote:string,confidence:string>>, formula_lines array<struct<ingredient:string,percentage:string,source_index:string>>"


def model_output(raw: Column) -> Column:
    """struct<answer, citations, formula_lines> of what a model wrote: a JSON object, also in a code
    fence or within prose; without an answer in it, the whole text is the answer.

    Citations without an index or a quote, and lines without an ingredient or with an index that is
    no number, are dropped."""
    text = F.btrim(F.regexp_replace(F.btrim(F.coalesce(raw, F.lit(""))), r"(?i)^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found = F.coalesce(*[F.when(x["answer"].isNotNull(), x) for x in (F.from_json(text, _OUTPUT), F.from_json(inner, _OUTPUT))])
    trimmed = lambda c: F.btrim(F.coalesce(c, F.lit("")))
    index = lambda c: c.try_cast("int")
    cited = F.filter(found["citations"], lambda c: index(c["source_index"]).isNotNull() & (trimmed(c["quote"]) != ""))
    level = lambda c: F.when(F.lower(c).isin(CONFIDENCE), F.lower(c)).otherwise(CONFIDENCE[0])
    cited = F.transform(cited, lambda c: F.struct(index(c["source_index"]).alias("source_index"), trimmed(c["quote"]).alias("quote"), level(c["confidence"]).alias("confidence")))
    lines = F.filter(found["formula_lines"], lambda c: (trimmed(c["ingredient"]) != "") & (c["source_index"].isNull() | index(c["source_index"]).isNotNull()))
    lines = F.transform(lines, lambda c: F.struct(trimmed(c["ingredient"]).alias("ingredient"), F.nullif(trimmed(c["percentage"]), F.lit("")).alias("percentage"), F.coalesce(index(c["source_index"]), F.lit(0)).alias("source_index")))
    kinds = ("array<struct<source_index:int,quote:string,confidence:string>>", "array<struct<ingredient:string,percentage:string,source_index:int>>")
    empty = [F.array().cast(k) for k in kinds]
    return F.struct(F.btrim(F.coalesce(found["answer"], text)).alias("answer"), F.coalesce(cited.cast(kinds[0]), empty[0]).alias("citations"), F.coalesce(lines.cast(kinds[1]), empty[1]).alias("formula_lines"))


# Scores from which a structured answer is given without a model, and a hit is used at all.
DIRECT, USED = 80.0, 0.30


def can_answer_directly(score: Column, route: Column, n_lines: Column) -> Column:
    """Whether the best structured match answers a lookup by itself."""
    return (score >= DIRECT) & (route == "lookup") & (n_lines >= 2)


def usable(hits: DataFrame, least: float = USED) -> DataFrame:
    """Hits of queries whose best score reaches the floor; other queries have no sources."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("top_")).filter(F.col("top_") >= least).select("query_id")
    return hits.join(top, "query_id", "left_semi")
