"""Which repositories an organisation has: from a YAML file or from a folder of folders. A handful of names, read on the driver."""

from __future__ import annotations

from pathlib import Path


def from_yaml(config: str) -> dict[str, str]:
    """name -> folder of each entry below `repos`; a path counts from the file's folder, its last part is the default name.

    An entry without a path (only a url) is refused: there is nothing to scan."""
    import yaml

    file, out = Path(config), {}
    for entry in (yaml.safe_load(file.read_text()) or {}).get("repos", []):
        if "path" not in entry:
            raise KeyError(f"path of {entry.get('name', entry.get('url', 'a repository'))}")
        folder = (file.parent / entry["path"]).resolve()
        out[entry.get("name", folder.name)] = str(folder)
    return out


def from_directory(folder: str) -> dict[str, str]:
    """name -> folder of each folder that isn't hidden, by name."""
    return {child.name: str(child) for child in sorted(Path(folder).iterdir()) if child.is_dir() and not child.name.startswith(".")}
