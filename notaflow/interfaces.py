"""What adapters offer: readers of files, inboxes, sinks. Anything with these methods is one."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame


class Reader(Protocol):
    """Reads text out of a file's bytes; sources.mail.texts asks readers in order."""

    name: str
    least: int

    def read(self, content: bytes) -> str: ...


class Inbox(Protocol):
    """Fetches mail; sources.mail.attachments takes its rows as a table."""

    def connect(self) -> None: ...

    def fetch(self, subject: str) -> list[dict[str, Any]]: ...


class Sink(Protocol):
    """Takes a result; operators.export.write_csv and send_in_chunks are what sinks are made of."""

    def export(self, rows: DataFrame, destination: str) -> None: ...
