"""Fetching files before they are read: a driver-side step, source by source.

An ``Acquirer`` lists what is there, fetches what is newer than what we have into a folder for
each version, runs a hook, and says how it went. Files become visible when they are whole.
"""

from __future__ import annotations

import ftplib
import json
import re
import shutil
import subprocess
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Remote:
    """A file to fetch: where it is, its name here, and when it changed (unknown: always fetched)."""

    place: str
    name: str
    changed: datetime | None = None


@dataclass
class Status:
    version: str
    fetched: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    folder: str = ""


class Acquirer:
    """The steps that all sources share; a source says how to list and how to fetch."""

    def __init__(self, folder: str | Path, version: str | None = None, post: Callable[[Path], None] | None = None):
        self.folder, self.post, self._version = Path(folder), post, version

    def version(self) -> str:
        return self._version or datetime.now(timezone.utc).strftime("%Y%m%d")

    def listing(self) -> Iterable[Remote]:
        raise NotImplementedError

    def fetch(self, remote: Remote, target: Path) -> None:
        raise NotImplementedError

    def is_newer(self, remote: Remote, local: Path) -> bool:
        return not local.exists() or remote.changed is None or remote.changed.timestamp() > local.stat().st_mtime + 0.001  # file systems round

    def run(self, force: bool = False) -> Status:
        status = Status(self.version())
        target = self.folder / status.version
        target.mkdir(parents=True, exist_ok=True)
        status.folder = str(target)
        for remote in self.listing():
            local = target / remote.name
            if not force and not self.is_newer(remote, local):
                status.skipped.append(remote.name)
                continue
            part = local.with_name(local.name + ".part")
            self.fetch(remote, part)
            part.replace(local)
            status.fetched.append(remote.name)
        if self.post and status.fetched:
            self.post(target)
        return status


class NoAcquirer(Acquirer):
    """Nothing to fetch: the hook alone is run."""

    def listing(self) -> Iterable[Remote]:
        return []

    def run(self, force: bool = False) -> Status:
        status = super().run(force)
        if self.post:
            self.post(Path(status.folder))
        return status


class FolderAcquirer(Acquirer):
    """Files of a local path that match a pattern: copied, moved or linked, by time of change."""

    def __init__(self, source: str | Path, folder: str | Path, how: str = "copy", pattern: str = "*", **more):
        super().__init__(folder, **more)
        self.source, self.pattern = Path(source), pattern
        self.how = {"copy": shutil.copy2, "move": shutil.move, "link": lambda a, b: Path(b).symlink_to(Path(a).resolve())}[how]

    def listing(self) -> Iterator[Remote]:
        for path in sorted(self.source.glob(self.pattern)):
            if path.is_file():
                yield Remote(str(path), path.name, datetime.fromtimestamp(path.stat().st_mtime, timezone.utc))

    def fetch(self, remote: Remote, target: Path) -> None:
        self.how(remote.place, target)


class ManualAcquirer(Acquirer):
    """A folder that someone has filled; its name is the version, and nothing is fetched."""

    def __init__(self, folder: str | Path):
        path = Path(folder)
        if not path.is_dir():
            raise FileNotFoundError(f"{path} is no folder")
        super().__init__(path.parent, path.name)

    def listing(self) -> Iterable[Remote]:
        return []


class UrlAcquirer(Acquirer):
    """URLs, by the time that the server says they changed; without one they are fetched again."""

    def __init__(self, urls: list[str], folder: str | Path, **more):
        super().__init__(folder, **more)
        self.urls = urls

    def listing(self) -> Iterator[Remote]:
        for url in self.urls:
            yield Remote(url, url.rstrip("/").rpartition("/")[2] or "index", self.changed(url))

    def changed(self, url: str) -> datetime | None:
        return None

    def fetch(self, remote: Remote, target: Path) -> None:
        with urllib.request.urlopen(remote.place) as got, target.open("wb") as out:  # noqa: S310
            shutil.copyfileobj(got, out)


class DatedUrlAcquirer(UrlAcquirer):
    """URLs that are fetched only if they changed; the first one's date, or else its tag, is the version."""

    def _head(self, url: str):
        method = "HEAD" if url.startswith("http") else None
        with urllib.request.urlopen(urllib.request.Request(url, method=method)) as got:  # noqa: S310
            return got.headers

    def changed(self, url: str) -> datetime | None:
        text = self._head(url).get("Last-Modified")
        return parsedate_to_datetime(text) if text else None

    def version(self) -> str:
        if self._version:
            return self._version
        head = self._head(self.urls[0])
        if head.get("Last-Modified"):
            return parsedate_to_datetime(head["Last-Modified"]).strftime("%Y%m%d")
        return re.sub(r"\W", "", head.get("ETag", "")) or super().version()


class FtpAcquirer(Acquirer):
    """Files of a folder of an FTP server, by its time of change where it tells."""

    def __init__(self, host: str, path: str, folder: str | Path, pattern: str = ".*", connect=ftplib.FTP, **more):
        super().__init__(folder, **more)
        self.host, self.path, self.pattern, self.connect = host, path, re.compile(pattern), connect
        self.server = None

    def _open(self):
        if self.server is None:
            self.server = self.connect(self.host)
            self.server.login()
            self.server.cwd(self.path)
        return self.server

    def changed(self, name: str) -> datetime | None:
        try:
            stamp = self._open().voidcmd(f"MDTM {name}").split()[-1]
        except ftplib.error_perm:
            return None
        return datetime.strptime(stamp[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)

    def listing(self) -> Iterator[Remote]:
        for name in sorted(self._open().nlst()):
            if self.pattern.fullmatch(name):
                yield Remote(name, name, self.changed(name))

    def fetch(self, remote: Remote, target: Path) -> None:
        with target.open("wb") as out:
            self._open().retrbinary(f"RETR {remote.place}", out.write)


class DatedFtpAcquirer(FtpAcquirer):
    """The same; the newest file's date is the version."""

    def version(self) -> str:
        dates = [r.changed for r in self.listing() if r.changed]
        return self._version or (max(dates).strftime("%Y%m%d") if dates else super().version())


def _program(*command: str) -> str:
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{' '.join(command[:2])}: {done.stderr.strip()}")
    return done.stdout.strip()


class MirrorAcquirer(Acquirer):
    """A site fetched with the program wget, which keeps what has not changed."""

    def __init__(self, url: str, folder: str | Path, program: str = "wget", **more):
        super().__init__(folder, **more)
        self.url, self.program = url, program

    def listing(self) -> Iterable[Remote]:
        return []

    def run(self, force: bool = False) -> Status:
        status = super().run(force)
        _program(self.program, "--quiet", "--recursive", "--no-parent", *([] if force else ["--timestamping"]), "--directory-prefix", status.folder, self.url)
        status.fetched = sorted(str(p.relative_to(status.folder)) for p in Path(status.folder).rglob("*") if p.is_file())
        return status


class GitAcquirer(Acquirer):
    """A repository, cloned and then pulled; the short hash of its head is the version."""

    def __init__(self, repository: str, folder: str | Path, branch: str | None = None, **more):
        super().__init__(folder, **more)
        self.repository, self.branch, self.clone = repository, branch, Path(folder) / "clone"

    def version(self) -> str:
        return self._version or _program("git", "-C", str(self.clone), "rev-parse", "--short", "HEAD")

    def listing(self) -> Iterator[Remote]:
        for name in _program("git", "-C", str(self.clone), "ls-files").splitlines():
            yield Remote(str(self.clone / name), name.replace("/", "__"))

    def fetch(self, remote: Remote, target: Path) -> None:
        shutil.copy2(remote.place, target)

    def run(self, force: bool = False) -> Status:
        if not self.clone.exists():
            _program("git", "clone", "--quiet", *(["--branch", self.branch] if self.branch else []), self.repository, str(self.clone))
        else:
            _program("git", "-C", str(self.clone), "pull", "--quiet", "--ff-only")
        return super().run(force)


class ApiAcquirer(Acquirer):
    """Documents that a user's generator yields, as files of JSON lines of a bounded size."""

    def __init__(self, documents: Callable[[], Iterator[dict]], folder: str | Path, per_file: int = 10_000, name: str = "documents", **more):
        super().__init__(folder, **more)
        self.documents, self.per_file, self.name = documents, per_file, name

    def listing(self) -> Iterable[Remote]:
        return []

    def run(self, force: bool = False) -> Status:
        status = super().run(force)
        out, n, name = None, 0, ""
        for document in self.documents():
            if n % self.per_file == 0:
                if out:
                    self._done(out, name, status)
                name = f"{self.name}-{n // self.per_file}.ndjson"
                out = (Path(status.folder) / f"{name}.part").open("w", encoding="utf-8")
            out.write(json.dumps(document, ensure_ascii=False) + "\n")
            n += 1
        if out:
            self._done(out, name, status)
        if self.post:
            self.post(Path(status.folder))
        return status

    @staticmethod
    def _done(out, name: str, status: Status) -> None:
        out.close()
        Path(out.name).replace(Path(status.folder) / name)
        status.fetched.append(name)


class DriveAcquirer(UrlAcquirer):
    """Files shared by link on a drive: the link's id makes the URL that serves the file."""

    def __init__(self, links: dict[str, str], folder: str | Path, **more):
        super().__init__([self.direct(link) for link in links.values()], folder, **more)
        self.names = list(links)

    @staticmethod
    def direct(link: str) -> str:
        m = re.search(r"/d/([\w-]+)|[?&]id=([\w-]+)", link)
        if not m:
            raise ValueError(f"no file id in {link}")
        return f"https://drive.google.com/uc?export=download&id={m[1] or m[2]}"

    def listing(self) -> Iterator[Remote]:
        for url, name in zip(self.urls, self.names, strict=True):
            yield Remote(url, name)


class ContainerAcquirer(Acquirer):
    """A file that a container makes: it is run if it has to be, and the file copied out."""

    def __init__(self, container: str, path: str, folder: str | Path, command: list[str] | None = None, program: str = "docker", **more):
        super().__init__(folder, **more)
        self.container, self.path, self.command, self.program = container, path, command, program

    def listing(self) -> Iterator[Remote]:
        yield Remote(self.path, self.path.rpartition("/")[2])

    def fetch(self, remote: Remote, target: Path) -> None:
        if self.command:
            _program(self.program, "exec", self.container, *self.command)
        _program(self.program, "cp", f"{self.container}:{remote.place}", str(target))


class ReleaseAcquirer(UrlAcquirer):
    """Releases that a feed lists as {target, requires, url}: those that lead to the wanted one."""

    def __init__(self, feed: str, folder: str | Path, current: str | None = None, wanted: str | None = None, **more):
        super().__init__([], folder, **more)
        self.feed, self.current, self.wanted = feed, current, wanted

    def listing(self) -> Iterator[Remote]:
        from quillon.plans.release import update_path

        with urllib.request.urlopen(self.feed) as got:  # noqa: S310
            known = json.load(got)
        wanted = self.wanted or max(r["target"] for r in known)
        place = {f"{r['requires']}.{r['target']}" if r.get("requires") else r["target"]: r["url"] for r in known}
        for step in update_path(None, [(r["target"], r.get("requires")) for r in known], self.current, wanted):
            yield Remote(place[step], step + "." + place[step].rpartition(".")[2])


def put_object(spark: SparkSession, local: str, target: str, overwrite: bool = False) -> None:
    """A local file into any store that Hadoop's file systems reach; an existing one is an error unless overwritten."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(target)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not overwrite and store.exists(path):
        raise FileExistsError(target)
    store.copyFromLocalFile(False, overwrite, hadoop.Path(local), path)
