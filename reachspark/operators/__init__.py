"""Table-to-table operators on cells: statistics, stencils, distances, regions, polygons."""
