"""How a catalogue module registers its queries."""

from ..sources.tables import BASE


class Catalogue:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, base: bool = True):
        """Register a function (spark, sf_dir) under its name; `sql` may use the canonical tables."""

        def add(f):
            self.queries[f.__name__] = f
            if sql:
                text = sql.strip()
                self.sql[f.__name__] = ("with recursive " + BASE + (", " + text[5:] if text.lower().startswith("with ") else text)) if base else text
            return f

        return add
