"""factlode.sources"""
