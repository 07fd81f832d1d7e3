"""A judge that asks a language model over HTTP: a prompt goes out, a reply comes back. Any other callable of a prompt will do as well."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from urllib.request import Request, urlopen


@dataclass(frozen=True)
class ChatJudge:
    """A chat-completions endpoint, asked without randomness. It is sent to where the pairs are, so it holds settings only."""

    url: str
    model: str
    key: str = ""
    seconds: float = 60.0

    @classmethod
    def of_environment(cls) -> ChatJudge:
        """By JUDGE_URL, JUDGE_MODEL and JUDGE_KEY; without the first two there is no judge."""
        missing = [n for n in ("JUDGE_URL", "JUDGE_MODEL") if not os.environ.get(n)]
        if missing:
            raise ValueError(f"not set: {', '.join(missing)}")
        return cls(os.environ["JUDGE_URL"], os.environ["JUDGE_MODEL"], os.environ.get("JUDGE_KEY", ""))

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urlopen(Request(self.url, json.dumps(body).encode(), headers), timeout=self.seconds) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]
