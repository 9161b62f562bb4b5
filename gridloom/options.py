"""Options, global or for a block."""

from __future__ import annotations

_DEFAULTS = {"export_grid_mapping": True, "skip_missing_spatial_dims": False, "convention": None}
_CHECKS = {"export_grid_mapping": lambda v: isinstance(v, bool), "convention": lambda v: v is None or v in ("cf", "zarr")}
_current = dict(_DEFAULTS)


def get_option(name: str):
    return _current[name]


class set_options:  # noqa: N801  used as a statement and as a context
    """set_options(convention="zarr") sets options at once; as a context it puts the former ones back."""

    def __init__(self, **options):
        for name, value in options.items():
            if name not in _DEFAULTS:
                raise ValueError(f"{name!r} is no option; known: {sorted(_DEFAULTS)}")
            if not _CHECKS.get(name, lambda v: True)(value):
                raise ValueError(f"option {name!r} can't be {value!r}")
        self.before = {k: _current[k] for k in options}
        _current.update(options)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        _current.update(self.before)
