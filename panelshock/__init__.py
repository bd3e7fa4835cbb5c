"""Event-response analytics over daily panels, written as Spark DataFrame jobs."""

from panelshock.spec import PanelSpec

__all__ = ["PanelSpec"]
