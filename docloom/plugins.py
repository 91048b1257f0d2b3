"""Hooks for what needs an outside codec: parsing, recognising and recoding.

Hooks are set on the driver.  An operator that uses one takes it when it is called and
sends it to the workers with its task, so that a hook must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol


class EngineNotConfiguredError(RuntimeError):
    """A hook is needed that nobody has set; the message names the setter."""


class FileEncryptedError(Exception):
    pass


class FileCorruptError(Exception):
    pass


class FileCancelledError(Exception):
    pass


class Recogniser(Protocol):
    """Finds words on a raster; made once per task and closed at its end."""

    def recognise(self, raster: bytes, width: int, height: int) -> list[dict]: ...

    def close(self) -> None: ...


_hooks: dict[str, Callable[..., Any]] = {}
SETTERS = {"parser": "set_parser", "recogniser": "set_recogniser_factory", "recoder": "set_recoder", "listener": "set_output_listener"}


def _set(name: str, hook: Callable[..., Any] | None) -> None:
    if hook is None:
        _hooks.pop(name, None)
    else:
        _hooks[name] = hook


def set_parser(loader: Callable[[bytes], Any] | None) -> None:
    _set("parser", loader)


def set_recogniser_factory(factory: Callable[[], Recogniser] | None) -> None:
    _set("recogniser", factory)


def set_recoder(recode: Callable[..., tuple[bytes, int, int] | None] | None) -> None:
    _set("recoder", recode)


def set_output_listener(listen: Callable[[str, int], None] | None) -> None:
    _set("listener", listen)


def is_configured(name: str) -> bool:
    return name in _hooks


def configured(name: str) -> Callable[..., Any] | None:
    return _hooks.get(name)


def hook(name: str) -> Callable[..., Any]:
    if name not in _hooks:
        raise EngineNotConfiguredError(f"No {name} is configured: call docloom.plugins.{SETTERS[name]}() first.")
    return _hooks[name]


def notify(name: str, size: int) -> None:
    """Tells the listener of a written file; its faults don't reach the writer."""
    listener = _hooks.get("listener")
    if listener:
        try:
            listener(name, size)
        except Exception:  # noqa: BLE001
            return
