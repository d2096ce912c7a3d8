"""A bounded memo for Python workers, which live as long as their executor."""

from __future__ import annotations


class Recent:
    """A dictionary of two generations: what was not used during the last ``size`` new entries goes."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def __len__(self) -> int:
        return len(self.new) + len(self.old)
