"""Panel time-series analytics and data-preparation operators on Spark DataFrames."""

from tidegrid.spec import Freq, PanelSpec, freq_to_sp

__all__ = ["Freq", "PanelSpec", "freq_to_sp"]
