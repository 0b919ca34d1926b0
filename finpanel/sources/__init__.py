from finpanel.sources.vendor import kpi_view, overflow_map, read_bom_csv, read_vendor, rename_legacy, rename_map
