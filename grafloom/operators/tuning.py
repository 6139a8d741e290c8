"""Prompts fitted to a corpus: a sample of its text units, examples within a token budget, and what a model tells of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from grafloom.operators import chunking, selection

Client = Callable[[str], str]

DOMAIN = "Name the field that these texts belong to.\n{docs}"
LANGUAGE = "Name the language that these texts are written in.\n{docs}"
PERSONA = "Describe an expert of {domain} who could do this: {task}."
TYPES = "You are {persona}. List the types of entities that matter in {domain}, parted by commas.\n{docs}"
RELATIONS = "You are {persona}. Answer in {language}. List entities of types {types} and their relationships.\nText: {doc}"
RATING = "You are {persona}. Describe how the importance of reports in {domain} should be rated.\n{docs}"
ROLE = "You are {persona}. Describe the role of a writer of reports in {domain}.\n{docs}"
TASK = "find the relations and the structure of a community in {domain}"
EXTRACTION = "Answer in {language}. List entities of types {types} and their relationships.\n{examples}\nText: {text}"
SUMMARIES = "You are {persona}. Answer in {language}. Sum up in one description.\nName: {name}\nDescriptions: {descriptions}"
REPORTS = "{role}\n{rating}\nAnswer in {language}. Write a report as JSON with title, summary, rating, rating_explanation and findings.\n{context}"


@dataclass
class Prompts:
    extraction: str
    summaries: str
    reports: str


def sample_units(documents: DataFrame, method: str = "random", limit: int = 15, size: int = 200, k: int = 15, most: int = 300, embed=None) -> list[str]:
    """Texts of a sample of small text units (see :func:`selection.sample`); the sample is bounded by its limit."""
    units = chunking.base_text_units(documents, size, 0).select("id", F.col("chunk").alias("text"))
    return [r.text for r in selection.sample(units, method, limit, k, most, embed=embed).select("text").collect()]


def pack_examples(examples: list[tuple[str, str]], budget: int, least: int = 3, count: Callable[[str], int] = lambda s: len(s.split())) -> str:
    """Examples (text, answer) one after another while the budget lasts, ``least`` of them in any case."""
    out: list[str] = []
    for i, (text, answer) in enumerate(examples):
        one = f"Example {i + 1}\nText: {text}\nAnswer: {answer}\n"
        if i >= least and count(one) > budget:
            break
        budget -= count(one)
        out.append(one)
    return "".join(out)


def generate(docs: list[str], client: Client, domain: str | None = None, language: str | None = None, budget: int = 2000, least: int = 3, most_examples: int = 5) -> Prompts:
    """Prompts for extraction, summaries and reports, written by a model that reads a sample: a call for each part, at most ``most_examples`` for examples."""
    text = "\n".join(docs)
    fill = lambda prompt, **values: client(_filled(prompt, **values, docs=text)).strip()
    domain = domain or fill(DOMAIN)
    language = language or fill(LANGUAGE)
    persona = fill(PERSONA, domain=domain, task=_filled(TASK, domain=domain))
    types = ", ".join(t.strip() for t in fill(TYPES, persona=persona, domain=domain).split(",") if t.strip())
    examples = [(d, fill(RELATIONS, persona=persona, language=language, types=types, doc=d)) for d in docs[:most_examples]]
    whole = _filled(EXTRACTION, language=language, types=types)
    packed = pack_examples(examples, budget - len(whole.split()), least)
    rating, role = fill(RATING, persona=persona, domain=domain), fill(ROLE, persona=persona, domain=domain)
    return Prompts(
        _filled(whole, examples=packed),
        _filled(SUMMARIES, persona=persona, language=language),
        _filled(REPORTS, role=role, rating=rating, language=language),
    )


def _filled(prompt: str, **values: str) -> str:
    for name, value in values.items():
        prompt = prompt.replace("{" + name + "}", value)
    return prompt


def tune(documents: DataFrame, client: Client, method: str = "random", limit: int = 15, embed=None, **more) -> Prompts:
    """Sample a corpus and generate its prompts."""
    return generate(sample_units(documents, method, limit, embed=embed), client, **more)
