"""The merge rules row by row, as a check on the set-based forms."""

from __future__ import annotations

import datetime as dt


class Table:
    """One row per generation; sightings come one at a time, in order."""

    def __init__(self, hours, priority=("edinburgh", "glasgow", "london")):
        self.rows, self.window, self.priority = [], dt.timedelta(hours=hours), priority

    def rank(self, city):
        return (self.priority.index(city.lower()) if city.lower() in self.priority else len(self.priority), city)

    def see(self, key, city, now, source):
        live = [r for r in self.rows if r["key"] == key and r["last"] >= now - self.window]
        if live:
            row = max(live, key=lambda r: r["last"])
            row["last"] = now
            if city not in row["cities"]:
                row["cities"] = sorted([*row["cities"], city], key=self.rank)
            return False
        self.rows.append({"key": key, "cities": [city], "first": now, "last": now, "source": source, "status": "new"})
        return True

    def expire(self, sources, now):
        for r in self.rows:
            if r["status"] == "new" and r["source"] in sources and r["last"] < now - self.window:
                r["status"] = "expired"

    def state(self):
        return sorted((r["key"], r["first"], r["last"], r["source"], tuple(r["cities"]), r["status"]) for r in self.rows)
