"""Model providers behind one interface: chat, embeddings and entailment.

The default is offline and deterministic. A provider is pickled to the executors and called in batches inside
``mapInPandas``; a client over HTTP can be registered without touching the operators.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.functions.payload import pick_string


class Provider(Protocol):
    def chat(self, prompt: str, system: str = "", temperature: float = 0.3) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def entail(self, premise: str, hypothesis: str) -> float: ...


@dataclass
class Offline:
    """Deterministic stand-in: answers by a given function, embeds by hashed character pairs, entails by shared characters."""

    dim: int = 64
    answer: Callable[[str], str] = field(default=lambda prompt: "{}")

    def chat(self, prompt: str, system: str = "", temperature: float = 0.3) -> str:
        return self.answer(prompt)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for a in (t[k : k + 2] for k in range(max(1, len(t) - 1))):
                h = int.from_bytes(hashlib.md5(a.encode()).digest()[:4], "big")
                v[h % self.dim] += 1.0 if h & 1 << 20 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    def entail(self, premise: str, hypothesis: str) -> float:
        wanted = set(hypothesis) - set("根据上述文本，。")
        return round(len(wanted & set(premise)) / len(wanted), 6) if wanted else 0.0

    def healthy(self) -> bool:
        return True


@dataclass
class Http:
    """Client of a service with the common chat and embeddings calls; waits 1, 2, 4 ... seconds between attempts."""

    url: str
    model: str
    key: str = ""
    embedding_model: str = ""
    timeout: float = 30.0
    attempts: int = 3
    max_tokens: int = 4096
    #: Ask for a JSON object; off for services that do not know the setting.
    json_answers: bool = True
    #: Address of a text-pair classifier; without one entailment is asked of the chat model.
    entailment_url: str = ""

    def _post(self, path: str, body: dict) -> dict:
        for k in range(self.attempts):
            try:
                request = urllib.request.Request(path if "://" in path else self.url.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
                if k + 1 == self.attempts:
                    raise
                time.sleep(2**k)
        raise AssertionError

    def chat(self, prompt: str, system: str = "", temperature: float = 0.3) -> str:
        """The content of the answer; where that is empty, the string of the whole answer that most looks like a payload."""
        return self._answer(prompt, system, temperature, self.json_answers)

    def _answer(self, prompt: str, system: str, temperature: float, as_json: bool) -> str:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": self.max_tokens, "stream": False}
        if as_json:
            body["response_format"] = {"type": "json_object"}
        choice = self._post("/chat/completions", body)["choices"][0]
        content = (choice.get("message") or {}).get("content")
        return content if isinstance(content, str) and content.strip() else pick_string({k: v for k, v in (choice.get("message") or {}).items() if k != "role"})

    def embed(self, texts: list[str]) -> list[list[float]]:
        got = self._post("/embeddings", {"model": self.embedding_model or self.model, "input": texts})
        return [x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])]

    def entail(self, premise: str, hypothesis: str) -> float:
        if self.entailment_url:
            try:
                return entailment_score(self._post(self.entailment_url, {"inputs": {"text": premise, "text_pair": hypothesis}}))
            except Exception:  # noqa: BLE001 - a judge that cannot be reached says nothing
                return 0.0
        said = re.search(r"\d*\.?\d+", self._answer(f"前提：{premise}\n假设：{hypothesis}\n只回答蕴含概率（0到1的小数）。", "", 0.0, False))
        return min(1.0, float(said[0])) if said else 0.0

    def healthy(self) -> bool:
        try:
            return bool(self._answer("ping", "", 0.3, False))
        except Exception:  # noqa: BLE001
            return False


def entailment_score(answer) -> float:
    """The largest score of a label that speaks of entailment, in a list of ``{label, score}`` nested however deep; 0 for none."""
    if isinstance(answer, dict) and "label" in answer:
        return float(answer.get("score") or 0.0) if "entail" in str(answer["label"]).lower() else 0.0
    parts = answer.values() if isinstance(answer, dict) else answer if isinstance(answer, (list, tuple)) else ()
    return max(map(entailment_score, parts), default=0.0)


@dataclass
class Classifier(Offline):
    """Entailment by a sequence-pair classifier that lies on the executors' disks; everything else as offline.

    The model is loaded at the first call in each Python worker and kept. Without the library or the model
    every pair scores 0, so that no bridge is taken on trust.
    """

    path: str = ""
    loaded: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"loaded": {}}

    def _model(self) -> Callable | None:
        if "model" not in self.loaded:
            try:
                from transformers import pipeline  # not a requirement

                self.loaded["model"] = pipeline("text-classification", model=self.path, top_k=None)
            except Exception:  # noqa: BLE001
                self.loaded["model"] = None
        return self.loaded["model"]

    def entail(self, premise: str, hypothesis: str) -> float:
        model = self._model()
        try:
            return entailment_score(model({"text": premise, "text_pair": hypothesis})) if model else 0.0
        except Exception:  # noqa: BLE001
            return 0.0


REGISTRY: dict[str, Callable[..., Provider]] = {"offline": Offline, "http": Http, "classifier": Classifier}


def create(name: str, **settings) -> Provider:
    if name not in REGISTRY:
        raise ValueError(f"no provider named {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**settings)


def ask(prompts: DataFrame, provider: Provider, prompt: str = "prompt", plans: tuple[tuple[float, str], ...] = ((0.3, ""), (0.1, "只输出JSON。"), (0.35, ""))) -> DataFrame:
    """Adds ``answer, status, seconds, attempt``: each prompt tried with the given temperatures and system messages until the answer is not empty.

    An error becomes the status of its row and stops nothing. Write the result before using it twice: models are dear and differ.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch[prompt]:
                began, answer, status, k = time.time(), None, "empty", 0
                for k, (temperature, system) in enumerate(plans, 1):
                    try:
                        answer = provider.chat(p, system, temperature)
                        status = "ok" if answer and answer.strip() else "empty"
                    except Exception as e:  # noqa: BLE001
                        answer, status = None, f"error: {type(e).__name__}"
                    if status == "ok":
                        break
                out.append((answer, status, time.time() - began, k))
            yield batch.assign(**dict(zip(("answer", "status", "seconds", "attempt"), map(list, zip(*out)) if out else ([], [], [], []))))

    return prompts.mapInPandas(run, fields + ", answer string, status string, seconds double, attempt int")


def entailment(provider: Provider) -> Callable[[Column, Column], Column]:
    """A function of two columns, the premise and the hypothesis, to a column of scores."""

    @F.pandas_udf("double")
    def score(premise: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series([float(provider.entail(p, h)) for p, h in zip(premise, hypothesis)])

    return score


def trace(asked: DataFrame, model: str, prompt: str = "prompt") -> DataFrame:
    """Audit rows of model calls; the prompt itself is kept only as length and SHA-256."""
    text = F.coalesce(F.col(prompt), F.lit(""))
    return asked.select(F.lit(model).alias("model"), F.length(text).alias("prompt_chars"), F.sha2(text, 256).alias("prompt_sha256"), F.length("answer").alias("answer_chars"), "status", "seconds", "attempt")
