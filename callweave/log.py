"""What a run did: operations, files read and commands, in three files, and debug topics by level."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame

TOPICS = ("parse", "import", "error", "sample")
_FILES = {"operations": "generation.log", "files": "files_accessed.txt", "commands": "commands_run.txt"}


class RunLog:
    """Writes below a folder of the driver's machine; level 0 keeps debug messages out, 3 has them all."""

    def __init__(self, folder: str, level: int = 0):
        self.folder, self.level = folder, level
        os.makedirs(folder, exist_ok=True)

    def _add(self, which: str, text: str) -> None:
        with open(os.path.join(self.folder, _FILES[which]), "a", encoding="utf-8") as f:
            f.write(text + "\n")

    def operation(self, text: str) -> None:
        self._add("operations", text)
        logging.getLogger("callweave").info(text)

    def command(self, text: str) -> None:
        self._add("commands", text)

    def files(self, rows: DataFrame) -> None:
        """The files that the rows are read from."""
        for path in rows.inputFiles():
            self._add("files", path)

    def debug(self, topic: str, text: str, level: int = 1) -> None:
        """A message of one of the TOPICS, through the logger of that name."""
        if topic not in TOPICS:
            raise ValueError(f"topic is one of {', '.join(TOPICS)}")
        if self.level >= level:
            self._add("operations", f"[{topic}] {text}")
            logging.getLogger(f"callweave.{topic}").debug(text)
