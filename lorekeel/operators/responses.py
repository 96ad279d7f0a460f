"""Responses of language models: providers, retries, and the checks a response must pass."""

from __future__ import annotations

import importlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date
from typing import Protocol

from lorekeel.schemas import ENTITY_TYPES


class ResponseError(ValueError):
    """A response that breaks a rule; the message says which."""


class ProviderError(RuntimeError):
    """A provider that gives no response."""


@dataclass(frozen=True)
class Usage:
    input_tokens: int = 0
    output_tokens: int = 0

    def __add__(self, other: Usage) -> Usage:
        return Usage(self.input_tokens + other.input_tokens, self.output_tokens + other.output_tokens)


class Provider(Protocol):
    """What a stage asks for a response. A provider must be picklable, or be made in the task by a factory."""

    model_name: str
    provider_name: str
    context_window: int

    def generate(self, prompt: str, system: str = "") -> tuple[str, Usage]: ...


@dataclass
class Scripted:
    """A provider that gives prepared responses in turn, then the last one for ever."""

    responses: list[str] = field(default_factory=lambda: ["{}"])
    model_name: str = "scripted"
    provider_name: str = "scripted"
    context_window: int = 4096
    calls: list[str] = field(default_factory=list)

    def generate(self, prompt: str, system: str = "") -> tuple[str, Usage]:
        self.calls.append(prompt)
        text = self.responses[min(len(self.calls), len(self.responses)) - 1]
        return text, Usage(-(-len(prompt) // 4), -(-len(text) // 4))


def ambiguity(text: str) -> float:
    """1 for a response that is invalid or has no entities, else the share of entities that are new; 0 for relationships."""
    try:
        body = parse_object(text)
    except ResponseError:
        return 1.0
    if "relationships" in body:
        return 0.0
    rows = body.get("entities")
    if not isinstance(rows, list) or not rows:
        return 1.0
    return sum(1 for r in rows if isinstance(r, dict) and r.get("new_entity")) / len(rows)


@dataclass
class Fallback:
    """Asks a second provider where the first fails or is too unsure; the usage of both adds up."""

    first: Provider
    second: Provider
    threshold: float = 0.5
    score: Callable[[str], float] = ambiguity

    @property
    def model_name(self) -> str:
        return f"{self.first.model_name}+{self.second.model_name}"

    @property
    def provider_name(self) -> str:
        return f"{self.first.provider_name}+{self.second.provider_name}"

    @property
    def context_window(self) -> int:
        return min(self.first.context_window, self.second.context_window)

    def generate(self, prompt: str, system: str = "") -> tuple[str, Usage]:
        try:
            text, used = self.first.generate(prompt, system)
        except ProviderError:
            return self.second.generate(prompt, system)
        if self.score(text) <= self.threshold:
            return text, used
        text, more = self.second.generate(prompt, system)
        return text, used + more


def ask(provider: Provider, prompt: str, check: Callable[[str], object], attempts: int = 2, system: str = "") -> tuple[object, Usage]:
    """A checked response; after a broken rule the provider is told which, and asked again."""
    used, said = Usage(), prompt
    for k in range(attempts):
        text, u = provider.generate(said, system)
        used += u
        try:
            return check(text), used
        except ResponseError as e:
            if k == attempts - 1:
                raise
            said = f"{prompt}\n\nThe last answer was not accepted: {e}. Answer again."
    raise ResponseError("no attempt was made")


def parse_object(text: str) -> dict:
    try:
        out = json.loads(text)
    except (TypeError, ValueError) as e:
        raise ResponseError("not JSON") from e
    if not isinstance(out, dict):
        raise ResponseError("not an object")
    return out


def _filled(row: dict, name: str, where: str) -> str:
    value = row.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ResponseError(f"{where}: {name} is missing")
    return value


def _rows(body: dict, name: str) -> list[dict]:
    rows = body.get(name)
    if not isinstance(rows, list):
        raise ResponseError(f"{name} is not an array")
    for i, r in enumerate(rows):
        if not isinstance(r, dict):
            raise ResponseError(f"{name}[{i}] is not an object")
    return rows


def check_entities(text: str, candidates: Iterable[str]) -> tuple[list[dict], list[dict]]:
    """(resolved, proposals) of a response to the first question. One broken rule rejects the whole response."""
    known = set(candidates)
    resolved, proposals = [], []
    for i, r in enumerate(_rows(parse_object(text), "entities")):
        at = f"entities[{i}]"
        base = {"surface_form": _filled(r, "surface_form", at), "context_snippet": _filled(r, "context_snippet", at)}
        chosen, new = r.get("entity_id") or None, r.get("new_entity") or None
        if (chosen is None) == (new is None):
            raise ResponseError(f"{at}: exactly one of entity_id and new_entity is needed")
        if chosen is not None:
            if chosen not in known:
                raise ResponseError(f"{at}: {chosen} is no candidate")
            resolved.append(base | {"entity_id": chosen})
            continue
        if not isinstance(new, dict):
            raise ResponseError(f"{at}: new_entity is not an object")
        kind = _filled(new, "entity_type", at)
        if kind not in ENTITY_TYPES:
            raise ResponseError(f"{at}: {kind} is no entity type")
        aliases = [a for a in new.get("aliases") or [] if isinstance(a, str) and a.strip()]
        proposals.append(base | {"canonical_name": _filled(new, "canonical_name", at), "entity_type": kind, "subtype": new.get("subtype") or None, "description": _filled(new, "description", at), "aliases": aliases})
    return resolved, proposals


def confidence(value: object) -> float | None:
    """A number within [0, 1]; NULL for anything else, truth values included."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value:
        return None
    return max(0.0, min(1.0, float(value)))


def day(value: object) -> str | None:
    """A date of a year, a month or a day as its first day; NULL for anything else."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", value.strip()) if isinstance(value, str) else None
    try:
        return date(*(int(x or 1) for x in m.groups())).isoformat() if m else None
    except ValueError:
        return None


def check_relationships(text: str, known_ids: Iterable[str], names: dict[str, str]) -> list[dict]:
    """Relationships of a response to the second question. Structure must be right; rows whose ends are unknown, or the
    same, are dropped, and an unknown qualifier is."""
    known = set(known_ids)
    lower = {k.lower(): v for k, v in names.items()}

    def end(ref: object) -> str | None:
        return ref if isinstance(ref, str) and ref in known else lower.get(ref.lower()) if isinstance(ref, str) else None

    out = []
    for i, r in enumerate(_rows(parse_object(text), "relationships")):
        at = f"relationships[{i}]"
        source, target = end(_filled(r, "source", at)), end(_filled(r, "target", at))
        label, snippet = _filled(r, "relation_type", at), _filled(r, "context_snippet", at)
        if source is None or target is None or source == target:
            continue
        out.append({"source_id": source, "target_id": target, "relation_type": label, "qualifier_id": end(r.get("qualifier")), "valid_from": day(r.get("valid_from")), "valid_until": day(r.get("valid_until")), "confidence": confidence(r.get("confidence")), "context_snippet": snippet})
    return out


# ---------------------------------------------------------------- providers behind an address
def try_import(name: str, needed_for: str):
    """An optional module, or an error that says what it is for."""
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ProviderError(f"{needed_for} needs the module {name}") from e


def post_json(url: str, body: dict, headers: dict[str, str], timeout: float = 120.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except (OSError, ValueError) as e:
        raise ProviderError(str(e)) from e


@dataclass
class Chat:
    """A provider behind an address that takes messages: a hosted service (its key in ``headers``) or a server of this machine.

    ``path_text``, ``path_in``, ``path_out`` say where the answer has its text and token counts; counts that are missing are 0.
    ``send`` does the posting and can be replaced.
    """

    url: str
    model_name: str
    provider_name: str = "chat"
    context_window: int = 8192
    headers: dict[str, str] = field(default_factory=dict)
    options: dict[str, object] = field(default_factory=dict)
    system_field: str | None = None  # where the instruction goes; among the messages if None
    path_text: tuple[str | int, ...] = ("message", "content")
    path_in: tuple[str | int, ...] = ("prompt_eval_count",)
    path_out: tuple[str | int, ...] = ("eval_count",)
    send: Callable[[str, dict, dict[str, str]], dict] = post_json

    def generate(self, prompt: str, system: str = "") -> tuple[str, Usage]:
        said = [{"role": "user", "content": prompt}]
        body: dict[str, object] = {"model": self.model_name, **self.options}
        if system and self.system_field:
            body[self.system_field] = system
        elif system:
            said.insert(0, {"role": "system", "content": system})
        answer = self.send(self.url, body | {"messages": said}, self.headers)
        text = _at(answer, self.path_text)
        if not isinstance(text, str) or not text.strip():
            raise ProviderError("an answer without text")
        return text, Usage(*(n if isinstance(n := _at(answer, p), int) else 0 for p in (self.path_in, self.path_out)))


def _at(value: object, path: tuple[str | int, ...]) -> object:
    for k in path:
        try:
            value = value[k]  # type: ignore[index]
        except (KeyError, IndexError, TypeError):
            return None
    return value


def hosted(model: str, key: str, url: str, window: int = 200_000, most: int = 4096) -> Chat:
    """A hosted service that takes the instruction apart from the messages and needs a key."""
    return Chat(url, model, "hosted", window, {"x-api-key": key}, {"max_tokens": most}, "system", ("content", 0, "text"), ("usage", "input_tokens"), ("usage", "output_tokens"))


def local(model: str, url: str = "http://localhost:11434/api/chat", window: int = 8192) -> Chat:
    """A server of this machine that answers in JSON, at once and not in parts."""
    return Chat(url, model, "local", window, {}, {"stream": False, "format": "json"})
