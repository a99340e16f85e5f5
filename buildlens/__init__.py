"""Build-profile analytics on Spark: compiler traces, span forests, unit profiles, samples."""

from importlib import import_module

#: Public names and their modules, which load at first use: tasks that need one helper don't import them all.
_PUBLIC = {
    "Traces": "buildlens.plans.trace",
    "build_forest": "buildlens.operators.forest",
    "profile": "buildlens.operators.profile",
    "read_commands": "buildlens.sources.units",
    "read_profile": "buildlens.sources.units",
    "write_profile": "buildlens.sources.units",
    "job_reports": "buildlens.operators.build",
    "register_functions": "buildlens.functions.sql",
}
__all__ = list(_PUBLIC)


def __getattr__(name: str):
    if name in _PUBLIC:
        return getattr(import_module(_PUBLIC[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
