"""The processing service: named stages with a lifecycle, an event bus, and a backend that can be swapped."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from mailweir.operators import processors
from mailweir.sources.config import read_options

Stage = Callable[[DataFrame], DataFrame]


def joined(errors: list[Exception]) -> str:
    """One error stands alone, several each on a line of their own."""
    return str(errors[0]) if len(errors) == 1 else "".join(f"\n{e}" for e in errors)


class Service:
    """Stages by name, in any case, and what runs when a backend starts and stops."""

    def __init__(self) -> None:
        self.stages: dict[str, Stage] = {}
        self.starting: list[tuple[Callable[[dict], None], list[bool]]] = []
        self.stopping: list[Callable[[], None]] = []

    def add_stage(self, name: str, stage: Stage) -> None:
        self.stages[name.lower()] = stage

    def add_option_stage(self, name: str, kind: type, make: Callable[[Any], Stage], config: dict[str, Any]) -> None:
        """A stage that is made from typed options of the configuration (see `config.read_options`)."""
        self.add_stage(name, make(read_options(config, kind)))

    def on_start(self, run: Callable[[dict], None]) -> None:
        self.starting.append((run, [False]))

    def on_stop(self, run: Callable[[], None]) -> None:
        self.stopping.append(run)

    def start(self, config: dict) -> None:
        """Run what hasn't run yet; all are tried, and those that fail are tried again by the next start."""
        errors = []
        for run, done in self.starting:
            if not done[0]:
                try:
                    run(config)
                    done[0] = True
                except Exception as e:
                    errors.append(e)
        if errors:
            raise RuntimeError(joined(errors))

    def stop(self) -> None:
        """Run all that stops; those that fail stay for the next time."""
        errors, left = [], []
        for run in self.stopping:
            try:
                run()
            except Exception as e:
                errors.append(e)
                left.append(run)
        self.stopping = left
        if errors:
            raise RuntimeError(joined(errors))

    def reset(self) -> None:
        self.starting, self.stopping = [], []


class Events:
    """Topics and their subscribers, called in order and at once; subscriptions may come before anything is published."""

    def __init__(self) -> None:
        self.held: dict[str, list[Callable[..., None]]] = {}

    def subscribe(self, topic: str, run: Callable[..., None]) -> None:
        self.held.setdefault(topic, []).append(run)

    def unsubscribe(self, topic: str, run: Callable[..., None]) -> None:
        self.held[topic].remove(run)

    def publish(self, topic: str, *values: Any) -> None:
        for run in list(self.held.get(topic, ())):
            run(*values)


class Backend:
    """The chains that save messages and check recipients, by configuration; replaceable while it is stopped."""

    def __init__(self, config: dict[str, Any], service: Service | None = None) -> None:
        self.service, self.state, self.config = service or Service(), "new", {}
        self.open(config)

    def open(self, config: dict[str, Any]) -> None:
        self.save = processors.chain(config.get("save_process", ""), self.service.stages)
        self.check = processors.chain(config.get("validate_process", ""), self.service.stages)
        self.service.start(config)
        self.config, self.state = config, "initialized"

    def start(self) -> None:
        if self.state not in ("initialized", "stopped"):
            raise RuntimeError(f"a backend that is {self.state} can't start")
        self.state = "running"

    def stop(self) -> None:
        if self.state == "running":
            self.service.stop()
            self.state = "stopped"

    def process(self, messages: DataFrame, task: str = "save") -> DataFrame:
        """The messages after the chain of a task, save or validate."""
        if self.state != "running":
            raise RuntimeError(f"the backend is {self.state}")
        return messages.transform(self.save if task == "save" else self.check)

    def swap(self, config: dict[str, Any]) -> bool:
        """Go over to another configuration; if that can't be opened, the old one is opened and started again, and the answer is false."""
        old = self.config
        self.stop()
        try:
            self.open(config)
        except Exception:
            self.open(old)
            self.start()
            return False
        self.start()
        return True
