"""Stop-word lists.

The lists are the defaults of Spark ML's ``StopWordsRemover``, shipped as
package data so that no jar or JVM is needed to read them (a test holds them
against ``StopWordsRemover.loadDefaultStopWords``).
"""

from __future__ import annotations

import functools
from importlib import resources


@functools.lru_cache(maxsize=None)
def stop_words(language: str) -> list[str]:
    raw = (resources.files("textpulse.data") / f"stopwords_{language}.txt").read_text("utf-8")
    return [w for w in raw.split("\n") if w.strip() and not w.startswith("#")]
