"""Sources and sinks: master tables, fixture projections, exports."""
