"""Markdown, JSON, XML and HTML output of a bounded selection."""

from . import json_out, markdown, xml_out

RENDERERS = {"markdown": markdown.render, "json": json_out.render, "xml": xml_out.render}
SUFFIXES = {"markdown": ".md", "json": ".json", "xml": ".xml"}
