"""Sections of a page: headings begin one, paragraphs and list items are its text."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd

BLOCKS, SKIPPED = {"p", "li"}, {"style", "script", "sup"}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Elements that end an open paragraph, as browsers do
CLOSING = {"p", "ul", "ol", "table", "div", "section", "article", "blockquote", "pre", *HEADINGS}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.title, self.level, self.parts = "", 0, []
        self.text: list[str] = []
        self.open: list[str] = []  # p and li elements, the outermost collects
        self.heading = ""
        self.skip = 0

    def flush(self):
        if self.parts:
            self.found.append({"title": self.title, "content": "\n\n".join(self.parts), "pow": self.level})
        self.parts = []

    def end_block(self):
        text = "".join(self.text).strip()
        if text:
            self.parts.append(text)
        self.text, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif self.open == ["p"] and tag in CLOSING or self.open == ["li"] and tag == "li":
            self.end_block()
        if tag in HEADINGS:
            if self.open:
                self.end_block()
            self.flush()
            self.heading, self.text = tag, []
        elif tag in BLOCKS and not self.heading:
            if self.open and self.open[-1] == tag == "li":
                self.open.pop()
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.heading:
            self.title, self.level = "".join(self.text), HEADINGS[tag]  # as it stands
            self.heading, self.text = "", []
        elif tag in self.open:
            while self.open.pop() != tag:
                pass
            if not self.open:
                self.end_block()
        elif self.open and tag in ("ul", "ol", "div", "body", "article"):
            if len(self.open) == 1:
                self.end_block()

    def handle_data(self, data):
        if (self.open or self.heading) and not self.skip:
            self.text.append(data)


def page_sections(html: str | None) -> list[dict]:
    r = _Reader()
    r.feed(html or "")
    r.close()
    if r.open:
        r.end_block()
    r.flush()
    return r.found


def sections_of(html: pd.Series) -> pd.Series:
    return html.map(page_sections)
