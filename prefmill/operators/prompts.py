"""Prompt texts for the two generation stages.

Templates are ordinary text with ``{domain}``, ``{task}``, ``{libraries}``, ``{code_forms}`` and (for
stage 2) ``{items}``; any of them can be replaced by the caller. What a template must keep is the
member names it asks for, because the response operators read those.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmill.functions.text import fill, json_string, list_repr

MODES = ("train", "header", "test")

STAGE1_TEMPLATES = {
    "train": (
        "Domain: {domain}\nTask: {task}\nLibraries you may use: {libraries}\nCode forms: {code_forms}\n\n"
        "Write one short Python example per code form. Give every example its own concrete use case, "
        "keep the code plain (no annotations, comments or docstrings), and add the request a person "
        "would type to get that code.\n"
        'Answer with one JSON object: {{"examples": [{{"use_case": "...", "code": "...", '
        '"prompt": "..."}}]}}, one entry per code form.\n'
    ),
    "header": (
        "Domain: {domain}\nTask: {task}\nLibraries you may use: {libraries}\nCode forms: {code_forms}\n\n"
        "Write one bare Python signature per code form: imports and the header line, for a class its "
        "initialiser header too, with no body, annotations or docstrings. Give each its own use case "
        "and the request a person would type to get only that header.\n"
        'Answer with one JSON object: {{"headers": [{{"use_case": "...", "header": "...", '
        '"prompt": "..."}}]}}, one entry per code form.\n'
    ),
    "test": (
        "Domain: {domain}\nTask: {task}\nLibraries you may use: {libraries}\nCode form: {code_forms}\n\n"
        "Write one short Python example in this code form for one concrete use case. Keep the code "
        "plain (no annotations or comments).\n"
        'Answer with one JSON object: {{"use_case": "...", "code": "..."}}\n'
    ),
}

STAGE2_TEMPLATES = {
    "train": (
        "Domain: {domain}\nTask: {task}\nCode forms: {code_forms}\nLibraries you may use: {libraries}\n\n"
        "Rewrite each example below as production code: full type annotations, docstrings and "
        "comments, better structure, unchanged behaviour.\n{items}\n"
        'Answer with one JSON object: {{"improved_examples": [{{"use_case": "...", '
        '"original_code": "...", "improved_code": "..."}}]}}, one entry per example.\n'
    ),
    "header": (
        "Domain: {domain}\nTask: {task}\nCode forms: {code_forms}\n\n"
        "Rewrite each header below with full type annotations, better names and a docstring for "
        "purpose, parameters, result and exceptions. Write no body.\n{items}\n"
        'Answer with one JSON object: {{"improved_headers": [{{"use_case": "...", '
        '"original_header": "...", "improved_header": "..."}}]}}, one entry per header.\n'
    ),
    "test": (
        "Domain: {domain}\nTask: {task}\nCode form: {code_forms}\n\n"
        "Rewrite the example below as production code: full type annotations, docstrings and "
        "comments, better structure, unchanged behaviour. Then write three requests for it: a plain "
        "one, one that names the code form, and one that names the code form and the input and output "
        "types.\n{items}\n"
        'Answer with one JSON object: {{"use_case": "...", "original_code": "...", '
        '"improved_code": "...", "prompt_default": "...", "prompt_code_form": "...", '
        '"prompt_code_form_types": "..."}}\n'
    ),
}

# Fixed value: the sentence that is appended to prompts on request.
PROMPT_BOOST = "Use docstrings and mypy typing."


def mode_guard(is_test: bool = False, is_header: bool = False) -> str:
    """The mode of two flags; test data has no header form."""
    if is_test and is_header:
        raise ValueError("test data cannot be made in header mode")
    return "test" if is_test else "header" if is_header else "train"


def _checked(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    return mode


def _combination_fields(df: DataFrame) -> dict[str, Column]:
    forms = F.col("code_form")
    if isinstance(df.schema["code_form"].dataType, T.ArrayType):
        forms = list_repr(forms)
    libraries = F.array_join("libraries", ", ") if "libraries" in df.columns else F.lit("")
    return {"domain": F.col("domain"), "task": F.col("task"), "libraries": libraries, "code_forms": forms}


def render_stage1(
    combos: DataFrame,
    mode: str = "train",
    templates: Mapping[str, str] = STAGE1_TEMPLATES,
    into: str = "first_prompt",
) -> DataFrame:
    """Add the stage-1 prompt of each combination."""
    return combos.withColumn(into, fill(templates[_checked(mode)], _combination_fields(combos)))


def items_json(items: Column, code_key: str, single: bool = False) -> Column:
    """Stage-1 items as indented JSON holding only use case and code; one object when ``single``."""

    def entry(item: Column, pad: str) -> Column:
        def member(key: str, field: str) -> list[Column]:
            text = F.coalesce(json_string(item.getField(field)), F.lit("null"))
            return [F.lit(f'{pad}  "{key}": '), text]

        return F.concat(
            F.lit(pad + "{\n"), *member("use_case", "use_case"), F.lit(",\n"), *member(code_key, "code"), F.lit(f"\n{pad}}}")
        )

    if single:
        return entry(F.get(items, F.lit(0)), "")
    body = F.array_join(F.transform(items, lambda x: entry(x, "  ")), ",\n")
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), body, F.lit("\n]")))


def render_stage2(
    parsed: DataFrame,
    mode: str = "train",
    templates: Mapping[str, str] = STAGE2_TEMPLATES,
    items: str = "first_items",
    into: str = "second_prompt",
) -> DataFrame:
    """Add the stage-2 prompt, which shows the stage-1 items without their prompts."""
    code_key = "header" if _checked(mode) == "header" else "code"
    fields = _combination_fields(parsed)
    fields["items"] = items_json(F.col(items), code_key, single=mode == "test")
    return parsed.withColumn(into, fill(templates[mode], fields))


def prompt_boost(prompt: Column, on: bool = True) -> Column:
    """The prompt with the fixed instruction appended when asked."""
    return F.concat(prompt, F.lit(PROMPT_BOOST)) if on else prompt


def sft_text(prompt: Column, chosen: Column, combine: bool = True) -> Column:
    """Training text: prompt, line break and chosen answer, or the answer alone."""
    return F.concat(prompt, F.lit("\n"), chosen) if combine else chosen
