"""Sources: folders of price lists and quotes as tables of cells, and XML or HTML as tables of paths and values."""
