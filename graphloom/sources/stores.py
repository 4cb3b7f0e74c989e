"""Small JSON stores beside a project: budget, dismissals, intents, history, configuration."""

from __future__ import annotations

import glob as globbing
import json
import os
import re
import subprocess
import time
import tomllib
from dataclasses import dataclass, field

FOLDER = ".graphloom"


def _read(root: str, name: str, empty):
    try:
        with open(os.path.join(root, FOLDER, name)) as f:
            return json.load(f)
    except (OSError, ValueError):
        return empty


def _write(root: str, name: str, data) -> None:
    os.makedirs(os.path.join(root, FOLDER), exist_ok=True)
    with open(os.path.join(root, FOLDER, name), "w") as f:
        json.dump(data, f, indent=2, sort_keys=True)
        f.write("\n")


def read_budget(root: str) -> dict | None:
    got = _read(root, "budget.json", None)
    return got if isinstance(got, dict) else None


def write_budget(root: str, stats: dict) -> None:
    _write(root, "budget.json", stats)


def dismissed(root: str) -> set[str]:
    """Ids of dismissed and fixed findings; old entries may be bare strings."""
    got = _read(root, "dismissed.json", {})
    got = got if isinstance(got, dict) else {}
    return {x if isinstance(x, str) else x.get("id", "") for x in got.get("dismissed", [])} | set(got.get("fixed", []))


def dismiss(root: str, finding: str, reason: str) -> None:
    got = _read(root, "dismissed.json", {})
    rows = [x if isinstance(x, dict) else {"id": x} for x in got.get("dismissed", []) if (x if isinstance(x, str) else x.get("id")) != finding]
    _write(root, "dismissed.json", {"dismissed": sorted([*rows, {"id": finding, "reason": reason, "at": int(time.time() * 1000)}], key=lambda x: x["id"]), "fixed": sorted(got.get("fixed", []))})


def intents(root: str) -> dict[str, dict]:
    got = _read(root, "intents.json", [])
    return {x["symbol"]: x for x in got if isinstance(x, dict) and "symbol" in x}


def set_intent(root: str, symbol: str, purpose: str, confirmed: bool = True, not_for: str = "") -> None:
    every = intents(root)
    every[symbol] = {"symbol": symbol, "purpose": purpose, "notFor": not_for, "status": "confirmed" if confirmed else "draft", "updatedAt": int(time.time() * 1000)}
    _write(root, "intents.json", [every[k] for k in sorted(every)])


def history(root: str, version: int) -> dict[str, dict]:
    """Points by commit, those of another version left out."""
    return {x["sha"]: x for x in _read(root, "history.json", []) if isinstance(x, dict) and x.get("version") == version and "sha" in x}


def write_history(root: str, points: dict[str, dict]) -> None:
    _write(root, "history.json", sorted(points.values(), key=lambda x: (x.get("at") or x.get("date") or "", x["sha"])))


@dataclass
class Config:
    """Settings of a scan: defaults, then what the manifests say, then the project's own file."""

    include: tuple[str, ...] = ("**/*.{ts,tsx,js,jsx,mjs,cjs,mts,cts,py,go,swift,mdx,md,vue,svelte,astro,html}",)
    exclude: tuple[str, ...] = ()
    entry: tuple[str, ...] = ()
    public: tuple[str, ...] = ()
    threshold: float = 0.72
    min_loc: int = 4
    max_findings: int = 20
    rules: list[dict] = field(default_factory=list)
    #: Lower-case names of what the manifests depend on.
    dependencies: set[str] = field(default_factory=set)


def _json(path: str) -> dict:
    """A JSON object, comments and trailing commas allowed; empty if there is none."""
    try:
        with open(path) as f:
            text = f.read()
    except OSError:
        return {}
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
    for clean in (text, re.sub(r",(\s*[}\]])", r"\1", bare)):
        try:
            got = json.loads(clean)
            return got if isinstance(got, dict) else {}
        except ValueError:
            continue
    return {}


def workspace_dirs(root: str) -> list[str]:
    """Folders of the workspaces that the package.json or pnpm-workspace.yaml of a root names."""
    named = _json(os.path.join(root, "package.json")).get("workspaces") or []
    globs = list(named.get("packages", [])) if isinstance(named, dict) else list(named)
    try:
        with open(os.path.join(root, "pnpm-workspace.yaml")) as f:
            globs += re.findall(r"(?m)^\s*-\s*['\"]?([^'\"#\n]+?)['\"]?\s*$", f.read())
    except OSError:
        pass
    found = {os.path.relpath(d, root) for g in globs if not g.startswith("!") for d in globbing.glob(os.path.join(root, g)) if os.path.isfile(os.path.join(d, "package.json"))}
    return sorted(found)


def _flat(x) -> list[str]:
    return [x] if isinstance(x, str) else [y for v in (x.values() if isinstance(x, dict) else x or []) for y in _flat(v)]


def _source(root: str, path: str) -> str | None:
    """The source file that a manifest's path, perhaps a build output, stands for."""
    stem = os.path.splitext(path.removeprefix("./"))[0]
    for s in (stem, *(stem.replace(f"{d}/", "src/", 1) for d in ("dist", "lib", "build", "out"))):
        for e in (".ts", ".tsx", ".js", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.js"):
            if os.path.isfile(os.path.join(root, s + e)):
                return s + e
    return None


def package_entries(root: str) -> tuple[list[str], list[str]]:
    """(entries, public) of package.json, those of its workspaces too."""
    entries, public = [], []
    for folder in (".", *workspace_dirs(root)):
        at, front = os.path.join(root, folder), "" if folder == "." else f"{folder}/"
        pkg = _json(os.path.join(at, "package.json"))
        scripts = [w for s in (pkg.get("scripts") or {}).values() for w in str(s).split() if w.endswith((".ts", ".js", ".mjs"))]
        entries += [front + p for x in _flat(pkg.get("bin")) + scripts if (p := _source(at, x))]
        public += [front + p for k in ("main", "module", "browser", "exports") for x in _flat(pkg.get(k)) if (p := _source(at, x))]
    return entries, public


def framework_entries(root: str) -> list[str]:
    """Files that manifests other than package.json start: workers, routes, Python scripts and tools."""
    found: list[str] = []
    for name in ("wrangler.toml", "wrangler.json", "wrangler.jsonc"):
        try:
            with open(os.path.join(root, name)) as f:
                found += re.findall(r"""(?m)^\s*"?main"?\s*[=:]\s*["']([^"']+)["']""", f.read())
        except OSError:
            continue
    found = [p for x in found if (p := _source(root, x))]
    for name in ("react-router.config", "remix.config"):
        if any(os.path.isfile(os.path.join(root, name + e)) for e in (".ts", ".js", ".mjs")):
            found += ["app/root.{ts,tsx,js,jsx}", "app/routes.{ts,js}", "app/routes/**", "app/entry.{client,server}.{ts,tsx,js,jsx}"]
    try:
        with open(os.path.join(root, "pyproject.toml"), "rb") as f:
            project = tomllib.load(f)
    except (OSError, ValueError):
        project = {}
    tables = [project.get("project", {}).get(k, {}) for k in ("scripts", "gui-scripts")] + [project.get("tool", {}).get("poetry", {}).get("scripts", {})]
    for target in (v for t in tables for v in t.values() if isinstance(v, str)):
        path = target.split(":")[0].replace(".", "/")
        found += [p for front in ("", "src/") for p in (f"{front}{path}.py", f"{front}{path}/__init__.py") if os.path.isfile(os.path.join(root, p))]
    found += [x for x in ("manage.py", "setup.py", "conftest.py", "wsgi.py", "asgi.py") if os.path.isfile(os.path.join(root, x))]
    return found


def dependencies(root: str) -> set[str]:
    """Lower-case names of declared dependencies, from every manifest; only presence matters."""
    out: set[str] = set()
    for folder in (".", *workspace_dirs(root)):
        pkg = _json(os.path.join(root, folder, "package.json"))
        for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            out |= {x.lower() for x in (pkg.get(part) or {})}
    top = [x for x in (os.listdir(root) if os.path.isdir(root) else []) if not x.startswith(".")]
    below = [y for x in top if os.path.isdir(os.path.join(root, x)) for y in os.listdir(os.path.join(root, x))]
    if "Package.swift" in top or any(x.endswith((".xcodeproj", ".xcworkspace")) for x in top) or any(x.endswith(".xcodeproj") for x in below):
        out.add("swift")
    for name in ("requirements.txt", "requirements-dev.txt", "requirements/base.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile"):
        try:
            with open(os.path.join(root, name)) as f:
                out |= {x.lower() for x in re.findall(r"""(?m)(?:^|["'\s,\[])([A-Za-z][\w.-]*)\s*(?:\[[^\]]*\])?\s*(?=[<>=!~;"',\]\s]|$)""", f.read())}
        except OSError:
            continue
    return out


def aliases(root: str) -> list[tuple[str, str]]:
    """(prefix, folder): what import specifiers mean by tsconfig paths, subpath imports, workspaces and go.mod."""
    found: list[tuple[str, str]] = []
    for name in ("tsconfig.json", "jsconfig.json"):
        options = _json(os.path.join(root, name)).get("compilerOptions") or {}
        base = os.path.normpath(options.get("baseUrl", "."))
        for spec, targets in (options.get("paths") or {}).items():
            found += [(spec.removesuffix("*"), os.path.normpath(os.path.join(base, t.removesuffix("*")))) for t in targets[:1]]
    pkg = _json(os.path.join(root, "package.json"))
    for spec, target in (pkg.get("imports") or {}).items():
        found += [(spec.removesuffix("*"), os.path.normpath(t.removesuffix("*").removesuffix(".js"))) for t in _flat(target)[:1]]
    for folder in workspace_dirs(root):
        own = _json(os.path.join(root, folder, "package.json"))
        if own.get("name"):
            shown = next((p for k in ("source", "module", "main", "exports") for x in _flat(own.get(k)) if (p := _source(os.path.join(root, folder), x))), None)
            found.append((own["name"], f"{folder}/{os.path.splitext(shown)[0]}" if shown else folder))
    try:
        with open(os.path.join(root, "go.mod")) as f:
            module = re.search(r"(?m)^module\s+(\S+)", f.read())
        found += [(f"{module[1]}/", "")] if module else []
    except OSError:
        pass
    return sorted({(a, "" if b == "." else b) for a, b in found}, key=lambda x: (-len(x[0]), x))


def load_config(root: str) -> Config:
    """The first of ``graphloom.json`` and ``.graphloom/config.json``; excludes add up, others replace."""
    entry, public = package_entries(root)
    c = Config(entry=(*entry, *framework_entries(root)), public=tuple(public), dependencies=dependencies(root))
    for name in ("graphloom.json", f"{FOLDER}/config.json"):
        try:
            with open(os.path.join(root, name)) as f:
                own = json.load(f)
        except (OSError, ValueError):
            continue
        for k, v in own.items():
            if k == "exclude":
                c.exclude = (*c.exclude, *v)
            elif hasattr(c, k):
                setattr(c, k, tuple(v) if isinstance(v, list) and k != "rules" else v)
        break
    return c


class Cached:
    """A value that is made again once it is older than some seconds."""

    def __init__(self, make, seconds: float = 30.0, clock=time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self.at: float | None = None
        self.value = None

    def get(self):
        now = self.clock()
        if self.at is None or now - self.at > self.seconds:
            self.value, self.at = self.make(), now
        return self.value


def remote_url(root: str) -> str | None:
    """The web address of the remote called origin, without user, password or ending."""
    got = subprocess.run(["git", "-C", root, "remote", "get-url", "origin"], capture_output=True, text=True)
    url = got.stdout.strip() if got.returncode == 0 else ""
    m = re.fullmatch(r"(?:(?:https?|ssh|git)://)?(?:[^@/]+@)?([^/:]+)(?::\d+)?[/:](.+?)(?:\.git)?/?", url)
    return f"https://{m[1]}/{m[2]}" if m else None


def read_lines(root: str, path: str, first: int, last: int) -> list[str]:
    """Lines of a file under a root, counted from 1; none for a file outside it."""
    full = os.path.realpath(os.path.join(root, path))
    if not full.startswith(os.path.realpath(root) + os.sep) or not os.path.isfile(full):
        return []
    with open(full, encoding="utf-8", errors="replace") as f:
        return f.read().split("\n")[max(first, 1) - 1 : last]
