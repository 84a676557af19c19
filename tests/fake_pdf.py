"""A parser for tests: a file of JSON with its pages' words, its outline, and a file that notes what is opened and read."""

import json


class Fake:
    def __init__(self, file):
        found = json.loads(file.read())
        self._pages, self._outline, self.log = found["pages"], found.get("outline", []), found["log"]
        self.pages = len(self._pages)
        self.note(f"open {found['name']}")

    def note(self, text):
        with open(self.log, "a", encoding="utf-8") as f:
            f.write(text + "\n")

    def words(self, page):
        self.note(f"page {page}")
        for n, text in enumerate(self._pages[page]):
            yield (text, 9.0 * n, 9.0 * n + 8, 100.0, 112.0, 100.0, 10.0, "Times", 800.0)

    def outline(self):
        for level, title, page in self._outline:
            yield (level, title, page)
