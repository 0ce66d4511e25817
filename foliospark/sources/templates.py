"""Prompt templates with `{{name}}` placeholders."""

from __future__ import annotations

TEMPLATES: dict[str, str] = {
    "fields-system": (
        "You translate front matter values of a Markdown document into {{language}}. "
        "Answer with one block per field, [[name]] value [[/name]], under the same names and nothing else.\n{{instructions}}"
    ),
    "fields-user": "{{fields}}",
    "body-system": (
        "You translate Markdown documents into {{language}}. Keep headings, links, code and markup as they are "
        "and answer with the translated document only.\n{{instructions}}"
    ),
    "body-user": "{{content}}",
    "diff-system": (
        "You keep the {{language}} translation of a Markdown document up to date. You get the original, what has changed in it as a "
        "unified diff, and the present translation. Answer with a unified diff of the translation; with nothing if it needs no change.\n{{instructions}}"
    ),
    "diff-user": "Original:\n{{original}}\n\nChanges:\n{{diff}}\n\nTranslation:\n{{translation}}",
    "diff-retry": "The answer below could not be applied to the translation. Send a correct unified diff.\n\n{{response}}\n\nTranslation:\n{{translation}}",
}


def template(name: str) -> str:
    """A template by name; an error names those that there are."""
    if name not in TEMPLATES:
        raise KeyError(f"no template {name!r}; there are {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[name]


def fill(text: str, values: dict[str, str]) -> str:
    """The text with values for placeholders, in one pass; unknown names stay and values aren't searched."""
    import re

    return re.sub(r"\{\{(\w+)\}\}", lambda m: values.get(m[1], m[0]), text)
