"""The contract of models: prompts in a column, texts out, in batches; and the chains around them.

A model is a function from a pandas Series of prompts to a Series of texts. It is loaded once for each
worker by its factory. No model ships with the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

ROLES = ("router", "generator", "grader")
Model = Callable[[pd.Series], pd.Series]

#: What each node of the agent asks its model: the role that answers, the system's text, and the user's text.
PROMPTS: dict[str, tuple[str, str, str]] = {
    "language_detector": ("router", "Name the language of the text.\n{format_instructions}", "Text:\n{text}"),
    "contextualize_question": ("generator", "Restate the question so that it can be understood without the history. Do not answer it.", "Language: {language}\nHistory:\n{history}\nQuestion: {question}"),
    "router": ("router", "Decide whether the question is small talk or needs documents.\nThe documents hold: {index_description}\n{example_prompt}\n{format_instructions}", "User question: {question}"),
    "conversational_agent": ("generator", "Today is {current_datetime}.\n{agent_prompt}\nAnswer in the user's language.", "Question: {question}\nChat history: {history}\nLanguage: {language}"),
    "retrieval_grader": ("grader", "Say whether the document helps to answer the question.\n{format_instructions}", "File name: {document_filename}\nDocument: {document}\nUser question: {question}"),
    "document_request_detector": ("router", "Say whether the user asks for documents themselves.\n{format_instructions}", "User question: {question}"),
    "document_response": ("generator", "Name the documents that the user may be looking for.", "Question: {question}\nDocuments: {documents}\nLanguage: {language}"),
    "generate": ("generator", "Today is {current_datetime}.\n{context_prompt}\nAnswer from the information given only.", "Information:\n{documents}\nQuestion:\n{question}\nLanguage: {language}\nAnswer:"),
    "transform_question": ("generator", "Improve the question for a search in documents.", "Question:\n{question}\nImproved question:"),
    "default_response": ("generator", "Say that no answer was found and ask for another wording.", "Question: {question}\nLanguage: {language}"),
    "hallucination_grader": ("grader", "Say whether the answer is supported by the facts.\n{format_instructions}", "Facts:\n{documents}\nAnswer: {generation}"),
    "answer_grader": ("grader", "Say whether the answer resolves the question.\n{format_instructions}", "Question: {question}\nAnswer: {generation}"),
    "error_handler": ("generator", "Explain the problem kindly in one of these languages: {language}.", "Exception: {exception}"),
}


@dataclass(frozen=True)
class Registry:
    """One model behind every role, each with its temperature. factory(role, temperature) gives the model; it runs on the workers."""

    factory: Callable[[str, float], Model]
    temperatures: Mapping[str, float] = field(default_factory=dict)

    def column(self, role: str, prompt: Column) -> Column:
        """The role's answer to each prompt. Answers may differ from call to call, so plans don't repeat or reorder them."""
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r}")
        return batch_model(self.factory, role, float(self.temperatures.get(role, 0)))(prompt)


def batch_model(factory: Callable[[str, float], Model], role: str, temperature: float) -> Callable[[Column], Column]:
    """A pandas UDF from prompts to texts; the model is built at a task's first batch. A null prompt gives null."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for prompts in batches:
            model = model or factory(role, temperature)
            out = pd.Series([None] * len(prompts), dtype=object)
            given = prompts.notna().to_numpy()
            if given.any():
                out[given] = list(model(prompts[given].reset_index(drop=True)))
            yield out

    return answer.asNondeterministic()


def render(name: str, **values: Column | str) -> Column:
    """A node's whole prompt; each {variable} must be given. A null value counts as empty."""
    _, system, human = PROMPTS[name]
    template = f"System: {system}\nHuman: {human}"
    parts, at = [], 0
    for start, end, variable in _variables(template):
        value = values[variable]
        parts += [F.lit(template[at:start]), F.coalesce(F.lit(value) if isinstance(value, str) else value, F.lit(""))]
        at = end
    return F.concat(*parts, F.lit(template[at:]))


def _variables(template: str) -> list[tuple[int, int, str]]:
    out, at = [], 0
    while (start := template.find("{", at)) >= 0:
        at = template.index("}", start) + 1
        out.append((start, at, template[start + 1 : at - 1]))
    return out


def free_text(answer: Column) -> Column:
    """The chain of free answers: reasoning taken off, then the final part."""
    return T.get_final(T.strip_think(answer))


def error_text(answer: Column) -> Column:
    """The chain of error messages: only reasoning is taken off."""
    return T.strip_think(answer)


def structured(answer: Column, name: str, domain: Sequence[str]) -> Column:
    return T.structured(answer, name, domain)


def ask(registry: Registry, name: str, **values: Column | str) -> Column:
    """A node's answer as free text."""
    out = registry.column(PROMPTS[name][0], render(name, **values))
    return error_text(out) if name == "error_handler" else free_text(out)
