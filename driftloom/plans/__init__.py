"""Plans over keyed long tables: windows, grids, forecasts, evaluation and backtests."""
