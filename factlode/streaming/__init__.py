"""factlode.streaming"""
