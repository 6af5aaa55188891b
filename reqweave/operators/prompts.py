"""Prompts for extraction, and their registry."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

#: What a reply has to look like; passed to a backend as its format.
REQUIREMENTS_SCHEMA = json.dumps(
    {
        "type": "array",
        "items": {
            "type": "object",
            "properties": {"code": {"type": ["string", "null"]}, "description": {"type": ["string", "null"]}},
        },
    }
)

ROLE = "You read technical documents and list the requirements they state."
TASK = (
    "For each requirement in the document give its code and its description. Take codes as they are written. "
    "Leave out page numbers, banners and comments even where they interrupt a description. "
    "Answer with a JSON array of objects with the keys code and description, and with nothing else."
)
EXAMPLES = """Document:
## ABC-1 / CREATED / T
The pump shall start within two seconds.
12
The pump shall stop when the tank is empty.
## ABC-2 / CREATED / R
The lamp shall be green.
Answer:
[{"code": "ABC-1", "description": "The pump shall start within two seconds. The pump shall stop when the tank is empty."}, {"code": "ABC-2", "description": "The lamp shall be green."}]

Document:
XY-7 : The door shall close by itself.
PROPRIETARY & CONFIDENTIAL
XY-8 : The door shall have a handle.
XY-9 : The door shall be red.
Answer:
[{"code": "XY-7", "description": "The door shall close by itself."}, {"code": "XY-8", "description": "The door shall have a handle."}, {"code": "XY-9", "description": "The door shall be red."}]"""
SEPARATOR = "-----"
VISION_TASK = (
    "Each image is a page of a technical document. List the requirements with code and description, "
    "and after the description the notes and tables that belong to it. Answer with a JSON array."
)


def extraction(text: Column, schema: str = "", few_shot: str = "", with_schema: bool = False) -> Column:
    """Role, task, examples if there are any, a separator and the document without surrounding white space.

    The schema goes to the backend; it is part of the prompt only if asked for.
    """
    parts = [ROLE, "", TASK]
    if with_schema and schema:
        parts += ["", "Schema:", schema]
    if few_shot.strip():
        parts += ["", "Examples:", few_shot.strip()]
    head = "\n".join([*parts, "", "Document:", SEPARATOR, ""])
    return F.concat(F.lit(head), strip(text))


def ad_hoc(task: str) -> Callable[..., Column]:
    """A prompt for a task in one's own words: the task, a separator and the document. Examples and schema stay out of it."""

    def made(text: Column, schema: str = "", few_shot: str = "", with_schema: bool = False) -> Column:
        return F.concat(F.lit(f"{task.strip()}\n\nDocument:\n{SEPARATOR}\n"), strip(text))

    return made


#: A short task for trying a model out.
TRIAL_TASK = "List the codes and descriptions of all requirements in the document, as a JSON array of objects."
PROMPTS: dict[str, Callable[..., Column]] = {"requirement_extraction": extraction, "trial": ad_hoc(TRIAL_TASK)}


def prompt(name: str, text: Column, schema: str = REQUIREMENTS_SCHEMA, include_few_shot: bool = True, with_schema: bool = False) -> Column:
    """The named prompt for a column of texts; ValueError for unknown names, before any job starts."""
    if name not in PROMPTS:
        raise ValueError(f"unknown prompt {name!r}; known: {', '.join(PROMPTS)}")
    return PROMPTS[name](text, schema, EXAMPLES if include_few_shot else "", with_schema)
