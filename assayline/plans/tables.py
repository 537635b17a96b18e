"""Results of an audit by name, worked out when they are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

from assayline.session import discard, settle


class Tables(Mapping):
    """name -> DataFrame. A table is made when it is first looked up, so one result costs nothing of the others.

    What several results are made of is a shared table (`shared`): it is written to the shared folder by the first
    result that needs it, read by the others, and removed by `close` (or at the end of a `with` block), after which no
    result that was made of it can be read.
    """

    def __init__(self, **makers: Callable[[], DataFrame]) -> None:
        self._makers, self._made, self._shared = dict(makers), {}, []

    def add(self, name: str, maker: Callable[[], DataFrame]) -> None:
        self._makers[name] = maker

    def shared(self, maker: Callable[[], DataFrame], name: str = "shared") -> Callable[[], DataFrame]:
        """The table that `maker` gives, written once, by the first call."""
        kept: list[DataFrame] = []

        def get() -> DataFrame:
            if not kept:
                kept.append(settle(maker(), name))
                self._shared.append(kept[0])
            return kept[0]

        return get

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def close(self) -> None:
        discard(*self._shared)
        self._shared.clear()

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
